"""Features over streams."""

from tidemark.streaming.rolling import stream_features

__all__ = ["stream_features"]
