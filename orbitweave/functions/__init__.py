"""Spark-first building blocks for turn-by-turn measurement analytics."""
