"""Incremental maintenance of the chunk table."""
