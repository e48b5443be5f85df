"""Incremental lakehouse operators for PySpark."""
