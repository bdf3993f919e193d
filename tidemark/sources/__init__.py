"""Reading series from files and writing feature tables."""

from tidemark.sources.tables import pack, read_series, unpack, write_features

__all__ = ["pack", "read_series", "unpack", "write_features"]
