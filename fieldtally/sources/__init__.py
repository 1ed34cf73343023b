"""Reading submissions and code lists, writing reports."""
