"""structlab: structure detection on Spark DataFrames."""
