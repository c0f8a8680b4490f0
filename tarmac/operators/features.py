"""Base features for flights (P9-P18) and for request rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import calendar as cal
from ..functions.coerce import strip, to_double, upper_key
from ..functions.timeofday import daypart
from ..schemas import BASE_FEATURE_COLUMNS, LABEL


def base_features(df: DataFrame, keep=("split",)) -> DataFrame:
    """Labeled rows -> the 16 base features + date + label.

    ``keep`` lists pass-through columns (the ``split`` tag) kept when present.
    """
    d = F.col("flight_date")
    out = df.withColumns({
        "YEAR": cal.year_of(d),
        "MONTH": cal.month_of(d),
        "is_weekend": cal.is_weekend("DAY_OF_WEEK"),
        "week_of_year": cal.iso_week(d),
        "day_of_month": cal.day_of_month(d),
        "route": cal.route(F.col("ORIGIN"), F.col("DEST")),
        "dep_daypart": daypart(F.col("CRS_DEP_HOUR"), closed_top=True),
    })
    out = out.withColumns({c: strip(c) for c in ("OP_CARRIER", "ORIGIN", "DEST", "route", "dep_daypart")})
    dist = F.col("DISTANCE")
    numeric = not isinstance(df.schema["DISTANCE"].dataType, T.StringType)
    out = out.withColumns({
        "DISTANCE": dist.cast("double") if numeric else to_double(dist),
        LABEL: F.col(LABEL).cast("tinyint"),
        "DAY_OF_WEEK": F.col("DAY_OF_WEEK").cast("tinyint"),
    })
    cols = ["flight_date", *BASE_FEATURE_COLUMNS, LABEL] + [c for c in keep if c in df.columns]
    return out.select(*cols)


def request_features(req: DataFrame) -> DataFrame:
    """Request rows -> model-side base features.

    Input columns: ``request_id, flight_date, carrier, origin, dest, dep_hour,
    dep_minute, distance``.  Arrival times are unknown for a request (null).
    Row-local projection: works unchanged on a streaming DataFrame.
    """
    d = F.col("flight_date").cast("date")
    dow = cal.iso_day_of_week(d)
    origin, dest, carrier = upper_key("origin"), upper_key("dest"), upper_key("carrier")
    hour = F.col("dep_hour").cast("int")
    return req.select(
        "request_id",
        d.alias("flight_date"),
        cal.year_of(d).alias("YEAR"),
        cal.month_of(d).alias("MONTH"),
        dow.alias("DAY_OF_WEEK"),
        cal.is_weekend(dow).alias("is_weekend"),
        cal.iso_week(d).alias("week_of_year"),
        cal.day_of_month(d).alias("day_of_month"),
        carrier.alias("OP_CARRIER"),
        origin.alias("ORIGIN"),
        dest.alias("DEST"),
        cal.route(origin, dest).alias("route"),
        daypart(hour, closed_top=False).alias("dep_daypart"),
        F.col("distance").cast("double").alias("DISTANCE"),
        hour.cast("tinyint").alias("CRS_DEP_HOUR"),
        (hour * 60 + F.col("dep_minute").cast("int")).cast("double").alias("CRS_DEP_MINUTES"),
        F.lit(None).cast("tinyint").alias("CRS_ARR_HOUR"),
        F.lit(None).cast("double").alias("CRS_ARR_MINUTES"),
    )


def request_validity(feats: DataFrame, airports=None, carriers=None) -> DataFrame:
    """Add ``is_valid`` and ``invalid_reason`` (F8): origin == dest, unsupported keys.

    Invalid rows are kept and flagged so a caller can route them apart.
    """
    reason = F.when(F.col("ORIGIN") == F.col("DEST"), F.lit("origin equals destination"))
    if airports is not None:
        ap = [a.strip().upper() for a in airports]
        reason = (reason.when(~F.col("ORIGIN").isin(ap), F.lit("unsupported origin"))
                  .when(~F.col("DEST").isin(ap), F.lit("unsupported destination")))
    if carriers is not None:
        reason = reason.when(~F.col("OP_CARRIER").isin([c.strip().upper() for c in carriers]),
                             F.lit("unsupported carrier"))
    return feats.withColumn("invalid_reason", reason).withColumn(
        "is_valid", F.col("invalid_reason").isNull())


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Requests to score and requests to reject (F8); without validity columns all are scored."""
    if "is_valid" not in requests.columns:
        return requests, None
    return requests.where(F.col("is_valid")), requests.where(~F.col("is_valid"))
