"""Event-memory analytics as Spark DataFrame plans."""
