"""Plans: the SQL entry point and the query catalogue."""
