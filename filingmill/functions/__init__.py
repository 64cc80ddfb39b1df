"""Column functions: text scalars, classifiers and financial arithmetic."""
