"""Column expressions: parsing, taxonomy, terms and text."""
