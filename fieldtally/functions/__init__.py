"""Column expressions; all built-in, none of them a Python UDF."""
