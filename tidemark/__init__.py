"""Rolling-window feature extraction over large collections of time series, on Spark DataFrames."""

__version__ = "0.1.0"
