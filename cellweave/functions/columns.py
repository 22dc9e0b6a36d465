"""Column expressions that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stored form of "no time".
UNSET = "1970-01-01 00:00:00"


def fold(col: Column | str) -> Column:
    """Lower-cased, then every character other than a-z and 0-9 removed. Null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def unset_time(kind: str = "timestamp_ntz") -> Column:
    """The unset time as a literal of a time column's type."""
    return F.lit(UNSET).cast(kind)


def is_set_time(col: str, kind: str = "timestamp_ntz") -> Column:
    """True where a time is neither null nor unset; a predicate the Parquet scan can take."""
    return F.col(col).isNotNull() & (F.col(col) != unset_time(kind))


def micros(col: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock time, whatever the session's time zone."""
    c = F.col(col) if isinstance(col, str) else col
    day = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    second = (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("bigint")
    return (
        day * F.lit(86_400_000_000)
        + F.hour(c).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(c).cast("bigint") * F.lit(60_000_000)
        + second
    )
