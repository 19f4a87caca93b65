"""Spark-native document refinement, hybrid retrieval and corpus preparation."""
