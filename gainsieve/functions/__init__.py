"""Column expressions: text parsing, JSON records, vectors, entropy."""
