"""Spark-first analytics over dialogue policies."""
