"""Compressed-matrix analytics on PySpark."""
