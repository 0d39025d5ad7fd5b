"""Spark DataFrame jobs for futures-positioning research across many series."""
