"""Column expressions: sequence text and numeric vectors."""
