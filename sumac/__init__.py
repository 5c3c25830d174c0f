"""Spark-native retrieval, evaluation and reference-integrity operators."""
