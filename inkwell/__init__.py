"""Spark-first analytics over collections of report-like texts."""
