"""Metric-space neighbour analytics on Spark."""
