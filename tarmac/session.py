"""Session construction and the shared folder used to cut lineage.

On a cluster ``spark.checkpoint.dir`` names a folder every executor can
reach (HDFS, S3, ...).  Written stage tables and ``checkpoint()`` both go
there.  Only when the setting is absent and the master is local (unit tests, a
bare local run) is a private folder taken; on a cluster that raises.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings that make the plans in this package behave as designed.
# Shuffle partitions are sized from the core count; AQE re-plans joins
# (broadcast conversion, skew split) and coalesces small shuffle partitions.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a method beyond 8,000 bytes; a stage whose generated code has one runs operator by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tarmac", extra: dict | None = None) -> SparkSession:
    """Create (or fetch) a session with this package's defaults."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("TARMAC_DRIVER_MEMORY", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def limit_methods(spark: SparkSession) -> None:
    """The method limit of ``_DEFAULT_CONF`` for a session built elsewhere, unless it has its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key, "65535") == "65535":
        spark.conf.set(key, _DEFAULT_CONF[key])


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for lineage cuts.

    Reads ``spark.checkpoint.dir`` from the session; sets a private one only
    when the session has none (tests, ad-hoc local runs).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tarmac-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage (a lost executor re-reads files instead of
    recomputing the plan), gives the planner exact file-size statistics for
    its broadcast decision, and lets later column pruning reach the scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    if partition_by:  # no rows, no file: the schema is given
        df.write.partitionBy(partition_by).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def stored_bytes(spark: SparkSession, path: str):
    """Path and length of every file below ``path`` (metadata only, nothing is read)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def materialize_family(frames: dict[str, DataFrame], keys: dict[str, list[str]],
                       name: str = "family") -> dict[str, tuple[DataFrame, int]]:
    """Write several small keyed tables in ONE job and read each back with its stored size in bytes.

    Every frame is ``keys[name] + values``; frames may differ in key columns
    but must have the same number and types of value columns.  Keys are
    normalised to strings ``_k0.._kN`` and values to ``_v0.._vM`` so the
    frames share one schema; the output is partitioned by frame name, so each
    read-back prunes to its own directory.  One listing of the written files
    returns all sizes (for broadcast decisions).
    """
    from functools import reduce

    from pyspark.sql import functions as F

    width = max(len(k) for k in keys.values())
    parts, layout = [], {}
    for tag, df in frames.items():
        ks = keys[tag]
        vals = [c for c in df.columns if c not in ks]
        layout[tag] = (ks, [df.schema[k].dataType for k in ks], vals)
        cols = [F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(ks)]
        cols += [F.lit(None).cast("string").alias(f"_k{i}") for i in range(len(ks), width)]
        cols += [F.col(v).alias(f"_v{j}") for j, v in enumerate(vals)]
        parts.append(df.select(*cols, F.lit(tag).alias("_t")))
    union = reduce(lambda a, b: a.unionByName(b), parts)
    spark = union.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    union.write.mode("overwrite").partitionBy("_t").parquet(path)
    stored = spark.read.parquet(path)
    tag_of = F.regexp_extract("path", "/_t=([^/]*)/", 1)
    sizes = {r["t"]: r["n"] for r in stored_bytes(spark, path).groupBy(tag_of.alias("t")).agg(F.sum("length").alias("n")).collect()}
    out = {}
    for tag, (ks, types, vals) in layout.items():
        t = stored.where(F.col("_t") == tag)
        cols = [F.col(f"_k{i}").cast(tp).alias(k) for i, (k, tp) in enumerate(zip(ks, types))]
        cols += [F.col(f"_v{j}").alias(v) for j, v in enumerate(vals)]
        out[tag] = (t.select(*cols), sizes.get(tag, 0))
    return out


def ensure_parallelism(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread an under-split input over the cluster's cores.

    A scan of one large, unsplittable file (a single Parquet row group) is
    one task; every narrow operator after it then runs single-threaded.  When
    the scan has fewer partitions than the default parallelism it is
    round-robin repartitioned; at scale (thousands of input splits) this is a
    no-op and adds no shuffle.
    """
    sc = df.sparkSession.sparkContext
    want = min_partitions or sc.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have < want else df
