"""Sequence and fingering analytics on Spark."""
