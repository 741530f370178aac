"""Compositions of operators and the registered, SQL-checked queries."""
