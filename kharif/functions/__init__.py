"""Column-expression builders: calendar, numeric, pricing rules."""
