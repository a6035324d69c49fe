"""Security-operations analytics as Spark jobs."""
