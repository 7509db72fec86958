"""Spark-first analytics for media libraries: near-duplicate grouping, quality rules, archives."""
