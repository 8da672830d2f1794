"""Search and analysis of annotated text over time, on Spark DataFrames."""
