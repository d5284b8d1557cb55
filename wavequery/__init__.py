"""wavequery: detector time series and trigger analytics on Spark DataFrames."""
