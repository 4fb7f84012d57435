"""Relational operators over quad and change DataFrames."""
