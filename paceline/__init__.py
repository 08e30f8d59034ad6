"""Operational event and metric analytics written as PySpark DataFrame pipelines."""
