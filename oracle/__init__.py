"""Independent SQL for the registered queries, run by DuckDB in the checks."""
