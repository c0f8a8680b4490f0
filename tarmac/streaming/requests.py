"""Structured Streaming scorer for request files.

Requests are row-local work plus left joins against static tables (the
lookup tables and the model), so a stream of request files is scored with
the same plan as a batch: ``readStream`` -> request features (P19) ->
stream-static lookups (V4, J5) -> model (E3) -> contributions and
explanations (H1-H5) -> ``writeStream`` Parquet.  The checkpoint lives
beside the output, so a restarted query resumes where it stopped and a lost
executor only re-runs its micro-batch tasks.

The store statistics (global rate, last date) are read once when the query
starts: two scalars, the snapshot the lookup tables belong to.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import model as MD
from ..operators import store as ST
from ..operators.features import request_features, request_validity
from ..plans import modeling as MO

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("flight_date", T.DateType()),
    T.StructField("carrier", T.StringType()),
    T.StructField("origin", T.StringType()),
    T.StructField("dest", T.StringType()),
    T.StructField("dep_hour", T.IntegerType()),
    T.StructField("dep_minute", T.IntegerType()),
    T.StructField("distance", T.DoubleType()),
])

OUTPUT_COLUMNS = ["request_id", "probability", "risk_bucket", "reasons", "contributions", "base_value",
                  "evidence", "bullets", "is_valid", "invalid_reason"]


def request_stream(spark: SparkSession, source_dir: str, fmt: str = "json", max_files_per_trigger: int = 100):
    """Request files arriving in ``source_dir`` as a streaming DataFrame."""
    return (spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
            .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))


def start_request_scoring(spark: SparkSession, source_dir: str, store_path: str, model_dir: str, out_dir: str,
                          checkpoint_dir: str | None = None, fmt: str = "json", airports=None, carriers=None,
                          available_now: bool = False, mode: str = "own",
                          lookups_root: str | None = None) -> StreamingQuery:
    """Start the scoring query; ``available_now`` processes what is there and stops."""
    model, cfg = MD.load(model_dir)
    store, stats = ST.load_store(spark, store_path, stats_path=f"{lookups_root}/stats" if lookups_root else None)
    stats = ST.stats_values(stats)
    feats = request_validity(request_features(request_stream(spark, source_dir, fmt)), airports, carriers)
    lookups = ST.load_lookups(spark, lookups_root, mode=mode, store=store) if lookups_root else None
    scored = MO.score_requests(spark, feats, store, model, cfg, mode=mode, stats=stats, lookups=lookups)
    out = scored.select(*OUTPUT_COLUMNS)
    # Tied to the output, so that a restart goes on where the last run stopped and appends nothing twice.
    ckpt = checkpoint_dir or f"{out_dir.rstrip('/')}_checkpoint"
    writer = out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.outputMode("append").start()
