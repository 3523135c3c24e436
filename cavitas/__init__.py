"""Surface-topography analytics on Spark DataFrames."""
