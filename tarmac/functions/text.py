"""Formatting helpers: percentages, ISO timestamps, JSON-safe values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def percent_1(c) -> Column:
    """``{p:.1%}`` via integer tenths of a percent, e.g. 0.2346 -> ``23.5%``.

    Integer arithmetic gives the same digits in every engine.  A value whose decimal form is a tie rounds
    up (0.2345 -> ``23.5%``), where a formatter on the exact binary value may round down.
    """
    t = F.round(_c(c) * F.lit(1000.0)).cast("long")
    return F.concat((t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"), F.lit("%"))


def iso_datetime(d) -> Column:
    """A midnight date rendered like ``Timestamp.isoformat()``: ``2024-01-05T00:00:00``."""
    return F.date_format(_c(d).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")


def iso_datetime_space(d) -> Column:
    """A midnight date rendered like ``str(Timestamp)``: ``2024-01-05 00:00:00``."""
    return F.date_format(_c(d).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")

