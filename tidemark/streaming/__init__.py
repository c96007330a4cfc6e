"""Streams of interaction events into rollups."""

from tidemark.streaming.rollup import roll_up, start_rollup

__all__ = ["roll_up", "start_rollup"]
