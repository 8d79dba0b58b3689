"""Incremental ingest of recordings that arrive in a folder."""

from aerolytics.streaming.ingest_stream import start_ingest_stream

__all__ = ["start_ingest_stream"]
