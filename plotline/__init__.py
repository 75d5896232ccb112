"""Spark-first analytics for property transactions and training corpora."""
