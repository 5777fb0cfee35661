"""Object-catalogue and detection-evaluation analytics on Spark DataFrames."""
