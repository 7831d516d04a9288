from twinstring.streaming.lookup import stream_neighbors

__all__ = ["stream_neighbors"]
