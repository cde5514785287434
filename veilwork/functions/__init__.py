"""Column expressions.  Every function takes and returns ``Column`` objects; no Python UDF."""
