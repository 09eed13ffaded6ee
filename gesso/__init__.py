"""gesso: imaging analytics as Spark DataFrame, SQL and streaming jobs."""
