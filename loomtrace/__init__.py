"""Log-trace analytics on PySpark: ingest, check, profile, split, retrieve and evaluate labelled event sequences."""

__version__ = "0.1.0"
