"""Point-in-time equity research data on Spark DataFrames."""
