"""Spindle: document, knowledge-graph and evaluation-data analytics on PySpark DataFrames."""

__all__ = ["session"]
