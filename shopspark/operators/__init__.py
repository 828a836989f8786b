"""Table operators: cleaning, contracts, integrity, increments, merge, ranking, search."""
