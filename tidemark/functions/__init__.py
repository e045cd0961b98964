"""Column expressions: names, labels, time and message parsers."""
