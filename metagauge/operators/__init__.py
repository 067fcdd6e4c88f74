"""Operators: each takes DataFrames and parameters and returns a lazy DataFrame, for one table or a whole fleet."""
