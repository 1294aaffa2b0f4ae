"""A property-graph engine and document operators on Spark DataFrames."""
