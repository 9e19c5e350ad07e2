"""Page-change and press-intelligence jobs on Spark DataFrames."""

__version__ = "0.1.0"
