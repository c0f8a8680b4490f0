"""Scoring a stream of requests against a store that moves on.

A snapshot is a feature store with its lookup tables and statistics, written in a folder of its own.  ``publish`` writes
them first and then appends one row, version and folder, to the table ``published``; until that row is there nobody reads the folder, and
no snapshot is ever changed.  Every micro-batch reads the newest row once and uses that snapshot's tables for all its rows, so a batch has one
version, kept in its output, and a snapshot published while the stream runs serves from the next batch on.

A micro-batch overwrites its own partition of the output: one that is run again after a lost driver or executor replaces what it had
written, also where a newer snapshot serves it by then.  Requests that are not valid are split off as in a batch (F8).

Cases: a stream without a published snapshot fails and names the folder; an empty micro-batch writes nothing; two publishers at once must
name their versions themselves, as an equal version would replace the other's tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..operators import model as MD
from ..operators import store as ST
from ..operators.features import request_features, request_validity, split_valid
from ..plans import modeling as MO
from ..plans import pipeline as P
from .requests import OUTPUT_COLUMNS, request_stream


def newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Version and folder of the newest published snapshot: one row, whatever the snapshots hold."""
    try:
        row = spark.read.schema("version long, path string").parquet(f"{root}/published").orderBy(F.desc("version")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row and (row["version"], row["path"])


def publish(spark: SparkSession, root: str, store: DataFrame, mode: str = "own", version: int | None = None) -> int:
    """Write a snapshot of ``store`` and make it the newest; its version."""
    if version is None:
        last = newest(spark, root)
        version = last[0] + 1 if last else 1
    path = f"{root}/v{version}"
    store.write.mode("overwrite").parquet(f"{path}/store")
    P.build_lookup_tables(spark, f"{path}/store", f"{path}/lookups", mode)
    spark.createDataFrame([(version, path)], "version long, path string").coalesce(1).write.mode("append").parquet(f"{root}/published")
    return version


def start_scoring(spark: SparkSession, source_dir: str, root: str, model_dir: str, out_dir: str, checkpoint_dir: str | None = None,
                  fmt: str = "json", airports=None, carriers=None, available_now: bool = False, mode: str = "own",
                  max_files_per_trigger: int = 100) -> StreamingQuery:
    """Start the query; scored rows go to ``out_dir`` and rejected ones to ``{out_dir}_rejected``, a partition per micro-batch."""
    model, cfg = MD.load(model_dir)
    out_dir = out_dir.rstrip("/")

    def score_batch(rows: DataFrame, batch: int) -> None:
        if rows.isEmpty():
            return
        found = newest(spark, root)
        if found is None:
            raise ValueError(f"no snapshot is published in {root}")
        version, path = found
        store, stats = ST.load_store(spark, f"{path}/store", stats_path=f"{path}/lookups/stats")
        lookups = ST.load_lookups(spark, f"{path}/lookups", mode=mode, store=store)
        valid, rejected = split_valid(rows)
        scored = MO.score_requests(spark, valid, store, model, cfg, mode=mode, stats=stats, lookups=lookups)
        wanted = [c for c in OUTPUT_COLUMNS if c not in ("is_valid", "invalid_reason")]
        scored.select(*wanted, F.lit(version).cast("long").alias("store_version")).write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")
        if rejected is not None:
            rejected.select("request_id", "invalid_reason").write.mode("overwrite").parquet(f"{out_dir}_rejected/batch={batch}")

    requests = request_validity(request_features(request_stream(spark, source_dir, fmt, max_files_per_trigger)), airports, carriers)
    writer = requests.writeStream.foreachBatch(score_batch).option("checkpointLocation", checkpoint_dir or f"{out_dir}_checkpoint")
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
