"""adsift: fraud-text screening and report analytics on Spark DataFrames."""
