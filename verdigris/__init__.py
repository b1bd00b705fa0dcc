"""verdigris: evaluation analytics for research-style question answering, on Spark DataFrames."""
