"""Column functions shared by the operators."""

from cellweave.functions.columns import fold, is_set_time, micros, unset_time

__all__ = ["fold", "is_set_time", "micros", "unset_time"]
