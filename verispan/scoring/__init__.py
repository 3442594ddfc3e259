"""Model inference behind a narrow interface; everything else runs as Spark plans."""
