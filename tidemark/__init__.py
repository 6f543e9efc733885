"""Tidemark: event analytics and training-data preparation on Spark."""
