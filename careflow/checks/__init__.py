"""Checked queries: Spark results beside DuckDB restatements."""
