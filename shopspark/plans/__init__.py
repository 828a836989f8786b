"""Whole jobs: the load, the business metrics and the search tables."""
