"""strandline: ordered, multi-series analytics and backtesting on Spark DataFrames."""
