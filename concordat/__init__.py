"""Concordat: evidence integration over many two-group result tables, as lazy Spark DataFrames."""

__version__ = "0.1.0"
