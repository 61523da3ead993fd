"""Schema-on-read data quality and publication on Spark DataFrames."""

__version__ = "0.1.0"
