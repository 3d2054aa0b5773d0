"""Functions of columns that several operators use."""
