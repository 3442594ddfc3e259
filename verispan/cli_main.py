"""What spark-submit runs."""

import sys

from verispan.cli import main

if __name__ == "__main__":
    sys.exit(main())
