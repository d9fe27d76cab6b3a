"""Column functions: text, distances, dates, sealed values."""
