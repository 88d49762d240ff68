"""Time-series and spectral analytics on Spark DataFrames."""
