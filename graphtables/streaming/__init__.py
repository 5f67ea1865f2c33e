"""Streaming form of the edge-list source and an append sink."""

from graphtables.streaming.edges import append_edges, read_edge_stream  # noqa: F401
