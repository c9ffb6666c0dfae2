"""Structured Streaming over entry logs."""

from .latest import ingest, latest_stream

__all__ = ["ingest", "latest_stream"]
