"""Spark-first engine for measuring and maintaining agent-memory data."""
