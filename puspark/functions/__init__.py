"""Vectorised NumPy helpers that run inside Spark tasks."""
