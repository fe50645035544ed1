"""shelfwise: catalogue-recommendation analytics as PySpark DataFrame jobs."""
