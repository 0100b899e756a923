"""Social-signal analytics as PySpark DataFrame operations."""
