"""Column expressions: cleaning, rounding, geography, text and vectors."""
