"""Scans, loads and the chunk table."""
