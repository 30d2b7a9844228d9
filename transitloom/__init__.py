"""Transport-network analytics as Spark jobs."""
