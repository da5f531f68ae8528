"""Series similarity search with calibrated recall, as PySpark DataFrame jobs."""
