"""Analytics of time-series features on Spark."""
