"""Ordered, evolving data on Spark: online learning and stream analytics as DataFrame operations."""
