"""Security-findings analytics as Spark DataFrame and Structured Streaming jobs."""
