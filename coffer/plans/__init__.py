"""The query catalogue (Spark builders plus DuckDB oracle SQL)."""
