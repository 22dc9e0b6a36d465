"""Frames over unbounded tables."""

from cellweave.streaming.incremental import windowed_one_hot_sums

__all__ = ["windowed_one_hot_sums"]
