"""Prose analytics on Spark."""
