"""Spark-native analytics over gridded vector embeddings."""
