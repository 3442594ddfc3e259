"""What an environment and a configuration look like, and what is wrong with them."""

from __future__ import annotations

import importlib
import platform
import subprocess
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .plans.stages import Run

LIBRARIES = ("pyspark", "pyarrow", "pandas", "numpy", "yaml")


def versions(run: Run) -> dict[str, str | None]:
    found: dict[str, str | None] = {"python": platform.python_version(), "spark": run.spark.version, "java": run.spark._jvm.java.lang.System.getProperty("java.version")}
    for name in LIBRARIES:
        try:
            found[name] = getattr(importlib.import_module(name), "__version__", None)
        except ImportError:
            found[name] = None
    return found


def commit() -> str | None:
    """The source's git commit, if there is one."""
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def diagnose(run: Run, model: str | None = None) -> dict:
    """ok, errors, warnings, versions and hashes."""
    errors, warnings = [], []
    found = versions(run)
    errors += [f"{name} is missing" for name in LIBRARIES if found[name] is None]
    if run.spark.conf.get("spark.sql.ansi.enabled") != "true":
        warnings.append("spark.sql.ansi.enabled is off")
    if run.spark.conf.get("spark.sql.adaptive.enabled") != "true":
        warnings.append("spark.sql.adaptive.enabled is off")
    data = run.config.dataset
    hashes = {}
    for name in ("response_path", "source_path"):
        try:
            hashes[name] = run.spark.read.text(getattr(data, name)).count()
        except Exception as error:  # noqa: BLE001  any reader error is what is to be reported
            errors.append(f"{name}: {str(error).splitlines()[0]}")
    for key in [model] if model else list(run.config.models):
        run.config.model(key)
    return {"ok": not errors, "errors": errors, "warnings": warnings, "versions": found, "lines": hashes, "commit": commit(), "config_sha256": run.config.digest()}
