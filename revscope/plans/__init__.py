"""Query registry and DuckDB oracle SQL."""
