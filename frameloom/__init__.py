"""frameloom: media-library deduplication and storage analytics on Spark DataFrames."""

__version__ = "0.1.0"
