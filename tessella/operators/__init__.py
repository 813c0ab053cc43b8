"""Operators on tables, matrices, graphs and ranges."""
