"""Earthquake-catalog analytics on Spark."""
