"""Readers of logs and records."""
