"""A property-graph and code-analytics engine on Spark DataFrames."""
