"""Document and concept analytics as PySpark DataFrame jobs."""
