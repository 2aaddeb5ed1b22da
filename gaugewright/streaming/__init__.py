"""Streams: message decoding and windows by ingest time."""
