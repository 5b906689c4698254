"""Column expressions: calendar parts, encodings, rounding, labels."""
