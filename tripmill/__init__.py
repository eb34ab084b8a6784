"""Trip analytics on Spark."""
