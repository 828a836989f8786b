"""Operators for preparing training text: duplicates, archives, scoring, mixing, packing and search."""
