"""DataFrame to DataFrame steps the reports are put together from."""
