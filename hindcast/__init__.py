"""hindcast: point-in-time features and decision analytics on Spark DataFrames."""
