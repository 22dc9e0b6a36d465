"""Storage of frames."""

from cellweave.sources.divisions import check_sorted, division_bounds

__all__ = ["check_sorted", "division_bounds"]
