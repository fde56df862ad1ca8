"""Tidemark: replicated-storage analytics and training-data preparation on Spark."""
