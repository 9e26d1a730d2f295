"""Composite analytics: one Spark job per function."""
