"""Spark jobs for manufacturing-quality data: ingest, bronze, silver, gold, checks, serving, documents and streams."""

__version__ = "0.1.0"
