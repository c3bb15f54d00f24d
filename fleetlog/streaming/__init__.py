"""Structured Streaming ingestion and running month-to-date totals."""
