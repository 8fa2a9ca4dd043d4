"""Container-terminal equipment analytics as Spark DataFrame jobs."""
