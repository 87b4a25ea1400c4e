"""Spark-first analytics over property graphs, text indexes and vectors."""
