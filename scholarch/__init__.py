"""Academic-archive analytics on Spark: ingest, clean, align, link, identify, merge, report."""

__version__ = "0.1.0"
