"""Time-series and training-data operators as Spark jobs."""
