"""Column functions of instants and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals; a null end or start doesn't match."""
    return F.coalesce((a_start <= b_end) & (a_end >= b_start), F.lit(False))


def within(at: Column, start: Column, end: Column) -> Column:
    return F.coalesce(at.between(start, end), F.lit(False))


def current(at: Column, available: Column, expires: Column) -> Column:
    """Half open: from ``available`` until before ``expires``."""
    return F.coalesce((at >= available) & (at < expires), F.lit(False))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, 0 for a clock that ran backwards."""
    return F.greatest(F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000), F.lit(0)).cast("long")
