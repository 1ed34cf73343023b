"""Every operator and report as a query on the star-schema tables, with its SQL counterpart."""
