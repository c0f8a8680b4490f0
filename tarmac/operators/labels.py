"""Typed -> labeled stage: scheduled times, flight date, label, drop rules.

P6-P10, F1, F2.  Every function maps a DataFrame to a DataFrame and stays
inside whole-stage codegen (no Python on executors).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import date_from_parts, month_of, year_of
from ..functions.coerce import nan_to_null
from ..functions.timeofday import hhmm_to_minutes, minutes_to_hour
from ..schemas import DELAY_THRESHOLD_MIN, LABEL


def derive_times(df: DataFrame, derived_time: bool = True) -> DataFrame:
    """HHMM -> ``CRS_*_MINUTES`` (double) and ``CRS_*_HOUR`` (tinyint)."""
    if not derived_time:
        return df
    dep_m = hhmm_to_minutes("CRS_DEP_TIME")
    arr_m = hhmm_to_minutes("CRS_ARR_TIME")
    return df.withColumns({
        "CRS_DEP_MINUTES": dep_m,
        "CRS_ARR_MINUTES": arr_m,
        "CRS_DEP_HOUR": minutes_to_hour(dep_m),
        "CRS_ARR_HOUR": minutes_to_hour(arr_m),
    })


def with_flight_date(df: DataFrame) -> DataFrame:
    """``flight_date`` = FL_DATE, else the date from YEAR/MONTH/DAY_OF_MONTH.

    Rows where both are missing keep a null date; :func:`checks.require_no_nulls`
    turns that into an error with sample rows, as the reference does.
    """
    parts = date_from_parts("YEAR", "MONTH", "DAY_OF_MONTH")
    fl = F.col("FL_DATE").cast("date") if "FL_DATE" in df.columns else F.lit(None).cast("date")
    return df.withColumn("flight_date", F.coalesce(fl, parts))


def label_flights(df: DataFrame, drop_cancelled_diverted: bool = True) -> DataFrame:
    """Typed rows -> labeled rows.

    * YEAR / MONTH are always re-derived from ``flight_date``.
    * Cancelled / diverted rows are dropped, a missing flag counts as 0.
    * ``arr_delay_minutes`` is ARR_DELAY with NaN -> null; rows without it
      are dropped; ``delayed_15`` = delay >= 15 minutes.
    """
    out = with_flight_date(df)
    out = out.withColumns({"YEAR": year_of("flight_date"), "MONTH": month_of("flight_date")})
    if drop_cancelled_diverted:
        for flag in ("CANCELLED", "DIVERTED"):
            if flag in out.columns:
                out = out.where(F.coalesce(F.col(flag).cast("int"), F.lit(0)) == 0)
    delay = nan_to_null(F.col("ARR_DELAY").cast("double"))
    out = out.withColumn("arr_delay_minutes", delay).where(F.col("arr_delay_minutes").isNotNull())
    return out.withColumn(LABEL, (F.col("arr_delay_minutes") >= F.lit(DELAY_THRESHOLD_MIN)).cast("tinyint"))
