"""Reports wired to the given tables, with a DuckDB check for each."""
