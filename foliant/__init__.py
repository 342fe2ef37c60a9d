"""Document analytics as Spark DataFrames."""
