"""Trading-time OHLCV analytics and data-quality operators on Spark DataFrames."""
