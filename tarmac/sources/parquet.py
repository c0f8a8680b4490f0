"""Parquet sources and sinks (S7-S11) and the JSON metrics sink/source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_dataset(spark: SparkSession, path: str, columns=None, schema=None) -> DataFrame:
    """Parquet scan with an optional column list (S7).  Pruning reaches ``ReadSchema``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def dataset_columns(spark: SparkSession, path: str) -> list[str]:
    """Schema-only read: column names from the footers."""
    return spark.read.parquet(path).columns


def write_partitioned(df: DataFrame, path: str, by=("YEAR", "MONTH"), sort_by: str | None = None,
                      mode: str = "overwrite") -> None:
    """Partitioned sink.

    The ``rebalance`` hint lets AQE cut output partitions to a target size
    and split a skewed month instead of one task writing it whole; an
    existing output is replaced (``overwrite``), or only the partitions being
    written when ``spark.sql.sources.partitionOverwriteMode=dynamic``.
    """
    out = df.hint("rebalance", *by)
    if sort_by:
        out = out.sortWithinPartitions(*by, sort_by)
    out.write.mode(mode).partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Unpartitioned sink: a directory of files, no forced single file."""
    df.write.mode(mode).parquet(path)


def load_split(spark: SparkSession, root: str, split: str, columns=None, missing: str = "error",
               label: str | None = "delayed_15") -> DataFrame | None:
    """One split of a dataset partitioned by ``split``.

    ``missing="error"`` raises when the split has no data, ``"skip"`` returns
    None.  The ``split`` predicate prunes partitions at the scan.
    """
    try:
        df = spark.read.parquet(root)
    except AnalysisException:
        if missing == "skip":
            return None
        raise
    df = df.where(F.col("split") == split)
    if label is not None and label not in df.columns:
        raise ValueError(f"label column {label!r} missing in {root}")
    if df.isEmpty():
        if missing == "skip":
            return None
        raise ValueError(f"split {split!r} is empty or missing in {root}")
    return df.select(*columns) if columns else df


def write_json(df: DataFrame, path: str) -> None:
    """Metrics / small tables as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.option("multiLine", multiline).json(path)
