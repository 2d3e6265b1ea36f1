"""Spark-native data grounding, query evaluation and corpus preparation."""
