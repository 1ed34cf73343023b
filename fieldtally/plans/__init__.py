"""Whole data flows: cleaning, enrichment, reports, option lists, export."""
