"""Loading submissions as they land."""
