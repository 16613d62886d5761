"""Spark-first building blocks: sources."""
