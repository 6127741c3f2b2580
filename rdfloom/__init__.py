"""SPARQL 1.1 over Spark: triples or mapped tables in, DataFrames out."""

from rdfloom.engine import Dataset, Result

__all__ = ["Dataset", "Result"]
