"""Evidence tracing and text analytics on Spark."""
