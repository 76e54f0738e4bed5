"""Rule-driven review of large text corpora on Spark DataFrames."""

__version__ = "0.1.0"
