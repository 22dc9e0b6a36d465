"""The labelled sparse frame."""

from cellweave.frame.build import event_matrix, one_hot
from cellweave.frame.core import SparseFrame, concat, vstack

__all__ = ["SparseFrame", "concat", "event_matrix", "one_hot", "vstack"]
