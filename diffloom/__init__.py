"""Change review on Spark."""
