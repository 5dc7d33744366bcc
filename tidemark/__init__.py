"""Incremental file ingestion and its analytics as Spark DataFrame operators."""
