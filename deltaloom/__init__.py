"""Typed tables, a small SELECT dialect and incrementally maintained views on Spark DataFrames."""
