"""Analytics of timed text and series on Spark."""
