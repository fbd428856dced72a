"""Whole plans: stand-in inputs, ingestion, answering, and the query catalogue."""
