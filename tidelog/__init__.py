"""Analytics over multi-version key/value logs, on Spark DataFrames."""
