"""Two-space similarity search and training-data operators on Spark SQL."""
