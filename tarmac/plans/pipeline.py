"""The offline pipeline as staged entry points with keyword arguments (§3.1-§3.4).

Each stage reads the previous stage's Parquet output and writes its own;
inside a stage the work is one lazy plan.  Stage outputs live wherever the
caller points them (on a cluster: a shared file system or object store).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import checks, scope
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import store as ST
from ..operators.features import base_features, split_valid
from ..operators.labels import derive_times, label_flights, with_flight_date
from ..operators.rolling import add_rolling_features
from ..sources import parquet as PQ
from ..sources.csv import read_raw_csv
from . import modeling as MO


def clean(spark: SparkSession, csv_root: str, out_dir: str, derived_time: bool = True,
          strict: bool = False) -> DataFrame:
    """Raw CSV tree -> typed Parquet partitioned by YEAR/MONTH; returns the A9 profile."""
    typed = derive_times(read_raw_csv(spark, csv_root, strict=strict), derived_time)
    PQ.write_partitioned(typed, out_dir)
    stored = spark.read.parquet(out_dir)
    return scope.ingest_profile(stored, "FL_DATE")


def build_labels(spark: SparkSession, in_dir: str, out_dir: str, drop_cancelled_diverted: bool = True) -> DataFrame:
    """Typed -> labeled (P6, P9, P10, F1, F2); fails with sample rows on missing dates."""
    dated = with_flight_date(spark.read.parquet(in_dir))
    # Every typed row needs a date, also those that the label rules drop: counted in the job that writes.
    seen = Observation("dates")
    dated = dated.observe(seen, F.count_if(F.col("flight_date").isNull()).alias("undated"))
    PQ.write_partitioned(label_flights(dated, drop_cancelled_diverted), out_dir)
    if seen.get["undated"]:
        checks.require_no_nulls(with_flight_date(spark.read.parquet(in_dir)), "flight_date",
                                show_cols=["YEAR", "MONTH", "DAY_OF_MONTH", "FL_DATE"])
    return scope.year_month_preview(spark.read.parquet(out_dir))


def filter_scope(spark: SparkSession, in_dir: str, out_dir: str, cfg: S.ScopeConfig = S.DEFAULT_SCOPE) -> DataFrame:
    """Labeled -> scoped; error when nothing is left (F4, F5); returns the A6/A7 profile."""
    scoped = scope.scope_filter(spark.read.parquet(in_dir), cfg)
    checks.require_non_empty(scoped, "scope filter result")
    PQ.write_partitioned(scoped, out_dir)
    return scope.scope_profile(spark.read.parquet(out_dir))


def make_splits(spark: SparkSession, in_dir: str, out_root: str, splits: S.SplitConfig) -> DataFrame:
    """Scoped -> one dataset partitioned by split (F7, T1); each split must be non-empty."""
    df = spark.read.parquet(in_dir)
    tagged = scope.assign_splits(checks.all_present(df, "flight_date"), splits)
    PQ.write_partitioned(tagged, out_root, by=("split", "YEAR", "MONTH"), sort_by="flight_date")
    stored = spark.read.parquet(out_root)
    checks.require_splits_non_empty(stored)
    return scope.split_summary(stored)


def build_base(spark: SparkSession, splits_root: str, out_root: str) -> DataFrame:
    """Splits -> base features (P18), keeping the split tag."""
    base = base_features(spark.read.parquet(splits_root))
    PQ.write_partitioned(base, out_root, by=("split", "YEAR", "MONTH"))
    return scope.split_summary(spark.read.parquet(out_root))


def build_aggregates(spark: SparkSession, base_root: str, out_root: str, specs=S.SPECS, windows=S.WINDOWS,
                     alpha: float = S.ALPHA, rate_scope: str = "all") -> DataFrame:
    """Base -> base + rolling aggregates for every split."""
    base = spark.read.parquet(base_root)
    checks.require_columns(base, ["flight_date", "DAY_OF_WEEK", "OP_CARRIER", "ORIGIN", "DEST", "route",
                                  "CRS_DEP_HOUR", S.LABEL])
    base = checks.all_present(base, "flight_date")
    out = add_rolling_features(base, specs, windows, alpha, rate_scope)
    PQ.write_partitioned(out, out_root, by=("split", "YEAR", "MONTH"))
    return scope.split_summary(spark.read.parquet(out_root))


def build_feature_store(spark: SparkSession, with_aggs_root: str, out_path: str) -> DataFrame:
    """With-aggregates -> feature store (V1); returns the A10 profile."""
    PQ.write_table(ST.build_store(spark.read.parquet(with_aggs_root)), out_path)
    store = spark.read.parquet(out_path)
    return store.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(S.aggregate_columns())).alias("agg_cols"),
                     F.min("flight_date").alias("date_min"), F.max("flight_date").alias("date_max"))


def build_lookup_tables(spark: SparkSession, store_path: str, out_root: str, mode: str = "own") -> None:
    """Feature store -> six lookup tables + one-row stats."""
    store = spark.read.parquet(store_path)
    for spec in S.SPECS:
        tbl = ST.lookup_table_own(store, spec) if mode == "own" else ST.lookup_first_key(store, spec)
        PQ.write_table(tbl, f"{out_root}/by_{spec.name}")
    PQ.write_table(ST.store_stats(store), f"{out_root}/stats")


def train(spark: SparkSession, with_aggs_root: str, out_dir: str, cfg: MD.ModelConfig | None = None,
          caps=None) -> DataFrame:
    """Train, evaluate on val and test, persist model + metrics + feature list."""
    cfg = cfg or MD.ModelConfig()
    wa = spark.read.parquet(with_aggs_root)
    model = MO.train(wa, cfg, caps)
    metrics = MO.evaluate_splits(model, wa, cfg)
    MD.save(model, cfg, out_dir, metrics, report=MO.training_report(wa, model, cfg))
    return spark.read.json(f"{out_dir}/metrics")


def score(spark: SparkSession, requests: DataFrame, store_path: str, model_dir: str, out_path: str,
          mode: str = "own", lookups_root: str | None = None) -> None:
    """Requests table -> scored and explained table.

    With ``lookups_root`` the persisted lookup tables and store statistics of
    :func:`build_lookup_tables` (of the same ``mode``) are used instead of rebuilding them.  Invalid
    requests are not scored: they go to ``{out_path}_rejected`` with their reason (F8).
    """
    model, cfg = MD.load(model_dir)
    store, stats = ST.load_store(spark, store_path, stats_path=f"{lookups_root}/stats" if lookups_root else None)
    lookups = ST.load_lookups(spark, lookups_root, mode=mode, store=store) if lookups_root else None
    valid, rejected = split_valid(requests)
    out = MO.score_requests(spark, valid, store, model, cfg, mode=mode, stats=stats, lookups=lookups)
    cols = ["request_id", "probability", "risk_bucket", "reasons", "contributions", "base_value",
            "evidence", "bullets"]
    PQ.write_table(out.select(*cols), out_path)
    if rejected is not None:
        PQ.write_table(rejected.select("request_id", "invalid_reason"), f"{out_path}_rejected")


def evaluate_table(df: DataFrame, label: str = "delayed_15", score_col: str = "probability",
                   threshold: float = 0.5, group_cols=("split",)) -> DataFrame:
    """Any scored table -> metrics per group."""
    return M.evaluate(df, label, score_col, threshold, list(group_cols))


def run_all(spark: SparkSession, csv_root: str, out_root: str, cfg: S.PipelineConfig,
            model_cfg: MD.ModelConfig | None = None, train_model: bool = True) -> dict:
    """Every offline stage in order, each reading the previous stage's output (§3.1, §3.2).

    Returns the small profile / summary / metrics tables of each stage.
    """
    out = out_root.rstrip("/")
    report = {
        "ingest": clean(spark, csv_root, f"{out}/typed"),
        "labels": build_labels(spark, f"{out}/typed", f"{out}/labeled", cfg.drop_cancelled_diverted),
        "scope": filter_scope(spark, f"{out}/labeled", f"{out}/scoped", cfg.scope),
        "splits": make_splits(spark, f"{out}/scoped", f"{out}/splits", cfg.splits),
        "base": build_base(spark, f"{out}/splits", f"{out}/base"),
        "aggregates": build_aggregates(spark, f"{out}/base", f"{out}/with_aggs", cfg.specs, cfg.windows,
                                       cfg.alpha, cfg.global_rate_scope),
        "store": build_feature_store(spark, f"{out}/with_aggs", f"{out}/store"),
    }
    build_lookup_tables(spark, f"{out}/store", f"{out}/lookups")
    if train_model:
        report["metrics"] = train(spark, f"{out}/with_aggs", f"{out}/model", model_cfg)
    return report
