"""Column expressions: parsing, codes, rates, text notes."""
