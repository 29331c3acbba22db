"""Graph and code-analytics operators, each a function from DataFrames to a DataFrame."""
