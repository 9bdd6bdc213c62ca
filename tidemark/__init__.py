"""Market-data analytics on Spark DataFrames: bars, quality rules, universes, trading costs and return analytics."""

__version__ = "0.1.0"
