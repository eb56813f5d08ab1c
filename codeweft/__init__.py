"""codeweft: code-intelligence analytics as Spark DataFrames."""
