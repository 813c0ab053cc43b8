"""Tessella: associative (key-value) tables as an algebra over Spark DataFrames."""
