"""Scheduled-time expressions: HHMM -> minutes / hour, and daypart bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Daypart bins, right-closed: (-1,5] night, (5,11] morning, (11,17] afternoon,
# (17,21] evening, (21,23] late.
DAYPARTS = (("night", 5), ("morning", 11), ("afternoon", 17), ("evening", 21), ("late", 23))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hhmm_to_minutes(c) -> Column:
    """HHMM integer -> minutes since midnight as double; minute part >= 60 -> null.

    Floor division / floor modulo, so -100 -> -60 and -5 -> null (minute 95).
    """
    v = _c(c).cast("bigint")
    h = F.floor(v / F.lit(100))
    m = F.pmod(v, F.lit(100))
    return F.when(m < 60, (h * 60 + m).cast("double"))


def minutes_to_hour(c) -> Column:
    """Minutes -> hour (floor / 60) as tinyint."""
    return F.floor(_c(c) / F.lit(60.0)).cast("tinyint")


def daypart(c, closed_top: bool = True) -> Column:
    """Daypart label from an hour (P16 batch rule, P17 request rule).

    ``closed_top=True``: hours outside (-1, 23] give null (batch binning).
    ``closed_top=False``: every hour above 21 is ``late`` and every hour
    up to 5 is ``night`` (the request form's open-ended rule).
    """
    h = _c(c)
    if closed_top:
        expr = F.when((h > -1) & (h <= DAYPARTS[0][1]), F.lit(DAYPARTS[0][0]))
        lo = DAYPARTS[0][1]
        for name, hi in DAYPARTS[1:]:
            expr = expr.when((h > lo) & (h <= hi), F.lit(name))
            lo = hi
        return expr
    expr = F.when(h <= DAYPARTS[0][1], F.lit(DAYPARTS[0][0]))
    for name, hi in DAYPARTS[1:-1]:
        expr = expr.when(h <= hi, F.lit(name))
    return F.when(h.isNotNull(), expr.otherwise(F.lit(DAYPARTS[-1][0])))
