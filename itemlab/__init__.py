"""Analytics of examination items on Spark."""
