"""opsframe: operations data as Spark DataFrames."""

__version__ = "0.1.0"
