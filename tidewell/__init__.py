"""tidewell: ordered multi-channel sample streams and packet streams as Spark DataFrames."""

__version__ = "0.1.0"
