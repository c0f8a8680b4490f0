"""Scope filter, time split and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import upper_key
from ..schemas import LABEL, ScopeConfig, SplitConfig

def normalize_keys(df: DataFrame, cols=("OP_CARRIER", "ORIGIN", "DEST")) -> DataFrame:
    """Strip + upper the key columns."""
    return df.withColumns({c: upper_key(c) for c in cols if c in df.columns})


def scope_filter(df: DataFrame, scope: ScopeConfig, date_col: str = "flight_date") -> DataFrame:
    """Inclusive date range and carrier / origin / dest membership (F4); rows without a date go.

    Predicates stay on plain columns, so the date range reaches the Parquet scan as a pushed filter.  A
    membership list is a set in the plan whatever its length; it is configuration, not data.
    """
    out = normalize_keys(df)
    d = F.col(date_col)
    out = out.where(d.isNotNull())
    if scope.start is not None:
        out = out.where(d >= F.lit(scope.start))
    if scope.end is not None:
        out = out.where(d <= F.lit(scope.end))
    for col, vals in (("OP_CARRIER", scope.carriers), ("ORIGIN", scope.origins), ("DEST", scope.dests)):
        if vals is not None:
            out = out.where(F.col(col).isin(sorted({str(v).strip().upper() for v in vals})))
    return out.select(df.columns)


def split_name(splits: SplitConfig, date_col: str = "flight_date"):
    """The split label for a date; null after ``test_end``."""
    d = F.col(date_col)
    return (F.when(d <= F.lit(splits.train_end), F.lit("train"))
            .when(d <= F.lit(splits.val_end), F.lit("val"))
            .when(d <= F.lit(splits.test_end), F.lit("test")))


def assign_splits(df: DataFrame, splits: SplitConfig, date_col: str = "flight_date") -> DataFrame:
    """Add ``split`` and drop rows after ``test_end``.

    One pass with a ``when`` chain instead of three filtered copies; the
    writer partitions by ``split`` (and sorts by date within partitions, T1).
    """
    return df.withColumn("split", split_name(splits, date_col)).where(F.col("split").isNotNull())


def split_summary(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    """Rows, delay rate and date range per split, all splits in one aggregate."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(LABEL).cast("double")).alias("delay_rate"),
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
    )


def scope_profile(df: DataFrame, date_col: str = "flight_date") -> DataFrame:
    """Row count, delay rate, date range and the sorted distinct key lists.

    The lists are bounded by the key domains (carriers, airports), and
    ``collect_set`` combines map-side, so no task sees the raw rows of a key.
    """
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.col(LABEL).cast("double")).alias("delay_rate"),
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
        F.array_sort(F.collect_set("OP_CARRIER")).alias("carriers"),
        F.array_sort(F.collect_set("ORIGIN")).alias("origins"),
        F.array_sort(F.collect_set("DEST")).alias("dests"),
    )


def year_month_preview(df: DataFrame, n: int = 10) -> DataFrame:
    """First ``n`` distinct (YEAR, MONTH) pairs in order."""
    return df.select("YEAR", "MONTH").distinct().orderBy("YEAR", "MONTH").limit(n)


def ingest_profile(df: DataFrame, date_col: str = "FL_DATE") -> DataFrame:
    """Shape and date range of an ingested table."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.min(date_col).alias("date_min"),
        F.max(date_col).alias("date_max"),
    )
