"""Structured Streaming forms of record ingest and of the decision log."""
