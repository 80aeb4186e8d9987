"""Measurement analytics as Spark DataFrame plans."""
