"""Spark-first analytics over versioned knowledge graphs."""
