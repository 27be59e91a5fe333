"""Speech-evaluation and routing analytics as Spark DataFrame jobs."""
