"""Bar research on Spark."""
