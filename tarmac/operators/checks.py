"""Single-pass assertions used at stage boundaries.

Each check is one aggregate job over the stage output; a failure raises with
at most ``sample`` example rows (never the whole table on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DataCheckError(ValueError):
    pass


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise DataCheckError(f"Missing required columns: {missing}")


def require_no_nulls(df: DataFrame, col: str, sample: int = 10, show_cols=None) -> None:
    """Raise when ``col`` has nulls, quoting up to ``sample`` offending rows."""
    n = df.agg(F.count_if(F.col(col).isNull())).first()[0]
    if n:
        cols = list(show_cols) if show_cols else df.columns
        rows = [r.asDict() for r in df.where(F.col(col).isNull()).select(*cols).limit(sample).collect()]
        raise DataCheckError(f"{n} rows have null {col}; e.g. {rows}")


def require_non_empty(df: DataFrame, what: str = "result") -> None:
    """Raise when a filter left nothing."""
    if df.isEmpty():
        raise DataCheckError(f"{what} is empty")


def require_splits_non_empty(df: DataFrame, names=("train", "val", "test")) -> DataFrame:
    """Counts per split in one aggregate; raise if any named split is empty."""
    counts = {r["split"]: r["rows"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("rows")).collect()}
    empty = [s for s in names if not counts.get(s)]
    if empty:
        raise DataCheckError(f"empty splits: {empty}")
    return df


def all_present(df: DataFrame, col: str) -> DataFrame:
    """``df``, failing in the job that reads it if ``col`` is null (no pass of its own)."""
    return df.withColumn(col, F.when(F.col(col).isNull(), F.raise_error(F.lit(f"null {col}"))).otherwise(F.col(col)))
