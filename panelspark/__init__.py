"""Expert matching and corpus analytics on Spark DataFrames."""
