"""Spark-first building blocks: streaming."""
