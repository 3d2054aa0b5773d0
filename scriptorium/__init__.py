"""Manuscript audit and training-text preparation on Spark DataFrames."""
