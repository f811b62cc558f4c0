"""News-intelligence analytics as Spark DataFrames."""
