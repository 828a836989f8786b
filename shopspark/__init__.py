"""Commerce analytics on Spark: load, check, merge, measure and search shop data."""
