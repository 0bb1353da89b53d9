"""Schedule and fleet analytics on Spark."""
