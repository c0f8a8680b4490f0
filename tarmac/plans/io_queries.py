"""Registered queries that write the fixture, read it back and compare, and checks of the model path.

Sources and sinks (S1-S12, T1), the store handle (V3), sample members (N1), model inputs (P21, P22), scores,
contributions (E3, H1) and evidence fields (H4).  Everything is written to the shared folder.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import checks as CK
from ..operators import encoding as EN
from ..operators import explain as X
from ..operators import metrics as M
from ..operators import model as MD
from ..operators import sampling as SM
from ..operators import store as ST
from ..operators import upkeep as U
from ..operators.scope import scope_filter
from ..session import materialize, shared_dir
from ..sources import parquet as PQ
from ..sources.csv import header_groups, read_raw_csv
from . import modeling as MO
from . import oracle as O
from . import queries as Q
from . import stages

_RAW = ["FL_DATE", "OP_CARRIER", "ORIGIN", "DEST", "CRS_DEP_TIME", "CRS_ARR_TIME", "ARR_DELAY", "DISTANCE", "CANCELLED", "DIVERTED"]


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/queries/{name}-{uuid.uuid4().hex[:12]}"


def _csv_tree(spark, sf_dir: str) -> str:
    """The fixture as CSV files of two layouts: even months reversed, with an alias and a padded header."""
    root = _folder(spark, "csv tree")
    # Written by layout first: the flights are joined once, not for each layout.
    f = materialize(stages.flights(spark, sf_dir).withColumn("_odd", F.col("MONTH") % 2), "flights", partition_by="_odd")
    odd, even = f.where("_odd = 1").drop("_odd"), f.where("_odd = 0").drop("_odd")
    even = even.withColumnsRenamed({"OP_CARRIER": "op_unique_carrier", "ORIGIN": " Origin "})
    odd.write.option("header", True).csv(f"{root}/odd")
    even.select(*[f"`{c}`" for c in reversed(even.columns)]).write.option("header", True).csv(f"{root}/even/deep er")
    return root


@Q.register("csv_roundtrip", "WITH " + O.FLIGHTS_SQL + f"""
SELECT FL_DATE, OP_CARRIER, ORIGIN, DEST, {O.i64('CRS_DEP_TIME')}, {O.i64('CRS_ARR_TIME')}, {O.r6('ARR_DELAY')},
  {O.r6('DISTANCE')}, {O.i64('CANCELLED')}, {O.i64('DIVERTED')} FROM flights""")
def q_csv_roundtrip(spark, sf_dir):
    return Q.present(read_raw_csv(spark, _csv_tree(spark, sf_dir), strict=True).select(*_RAW))


@Q.register("csv_layouts", "WITH " + O.FLIGHTS_SQL + f"""
SELECT CASE WHEN MONTH % 2 = 1 THEN 'YEAR' ELSE 'DIVERTED' END AS first_column, {O.i64('14', 'columns')},
  {O.i64('COUNT(*)', 'rows')} FROM flights GROUP BY ALL""")
def q_csv_layouts(spark, sf_dir):
    parts = []
    for header, paths in header_groups(spark, _csv_tree(spark, sf_dir)).items():
        names = header.split(",")
        rows = spark.read.option("header", True).csv(paths).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(rows.select(F.lit(names[0]).alias("first_column"), F.lit(len(names)).alias("columns"), "rows"))
    return Q.present(reduce(DataFrame.unionByName, parts))


@Q.register("parquet_partitions", "WITH " + O.LABELED + f"""
SELECT {O.i64('YEAR')}, {O.i64('MONTH')}, {O.i64('COUNT(*)', 'rows')}, MIN(flight_date) AS date_min, MAX(flight_date) AS date_max,
  {O.i64('SUM(delayed_15)', 'delayed')} FROM labeled GROUP BY YEAR, MONTH""")
def q_parquet_partitions(spark, sf_dir):
    path = _folder(spark, "partitions")
    PQ.write_partitioned(stages.labeled_flights(spark, sf_dir), path, sort_by="flight_date")
    return Q.present(spark.read.parquet(path).groupBy("YEAR", "MONTH").agg(
        F.count(F.lit(1)).alias("rows"), F.min("flight_date").alias("date_min"), F.max("flight_date").alias("date_max"),
        F.sum("delayed_15").alias("delayed")))


@Q.register("split_load", "WITH " + O.SPLIT + f"""
SELECT split, {O.i64('COUNT(*)', 'rows')}, {O.i64('SUM(delayed_15)', 'delayed')}, {O.i64('1', 'in_range')}
FROM split_rows GROUP BY split""")
def q_split_load(spark, sf_dir):
    path = _folder(spark, "splits")
    PQ.write_partitioned(stages.split_flights(spark, sf_dir), path, by=("split", "YEAR", "MONTH"), sort_by="flight_date")
    limits = stages.FIXTURE_SPLITS
    ends = {"train": limits.train_end, "val": limits.val_end, "test": limits.test_end}
    parts = [PQ.load_split(spark, path, s, ["flight_date", "delayed_15"]).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("delayed_15").alias("delayed"), (F.max("flight_date") <= F.lit(end)).alias("in_range"))
        .withColumn("split", F.lit(s)) for s, end in ends.items()]
    return Q.present(reduce(DataFrame.unionByName, parts))


@Q.register("metrics_json", Q.REGISTRY["evaluation"][1])
def q_metrics_json(spark, sf_dir):
    path = _folder(spark, "metrics")
    PQ.write_json(M.evaluate(stages.scored_fixture(stages.with_aggregates(spark, sf_dir)), threshold=0.5, group_cols=["split"]), path)
    return Q.present(PQ.read_json(spark, path))


@Q.register("store_handle", Q._STORE_SQL + f"""
SELECT {O.i64('COUNT(*)', 'rows')}, MIN(flight_date) AS date_min, (SELECT max_date FROM sstats) AS max_date,
  {O.r6('(SELECT sg FROM sstats)', 'global_rate')} FROM store""")
def q_store_handle(spark, sf_dir):
    root = _folder(spark, "store")
    PQ.write_table(stages.feature_store(spark, sf_dir), f"{root}/rows")
    PQ.write_table(ST.store_stats(PQ.read_dataset(spark, f"{root}/rows")), f"{root}/stats")
    store, stats = ST.load_store(spark, f"{root}/rows", stats_path=f"{root}/stats")
    known = ST.stats_values(stats)
    return Q.present(store.agg(F.count(F.lit(1)).alias("rows"), F.min("flight_date").alias("date_min"),
                               F.lit(known["max_date"]).alias("max_date"), F.lit(known["global_rate"]).alias("global_rate")))


@Q.register("sample_members", Q._SCORED_SQL + f"""
SELECT {O.i64(f"least(COUNT(*), {Q.SAMPLE_CAP})", 'rows')}, {O.i64('0', 'not_in_train')} FROM sc WHERE split = 'train'""")
def q_sample_members(spark, sf_dir):
    """Every member is a train row, and no row is drawn more often than it occurs."""
    train = stages.with_aggregates(spark, sf_dir).where(F.col("split") == "train")
    got = materialize(SM.capped_sample(train, Q.SAMPLE_CAP, "delayed_15"), "members")
    # Only train rows like a member can take one out; found by the base columns, before the join-back.
    own = [c for c in train.columns if c not in MD.S.aggregate_columns()]
    like = stages.with_aggregates(spark, sf_dir, pick=lambda base: SM.rows_like(base.where(F.col("split") == "train"), got, own))
    stray = got.exceptAll(like).agg(F.count(F.lit(1)).alias("not_in_train"))
    return Q.present(got.agg(F.count(F.lit(1)).alias("rows")).withColumn("not_in_train", stray.scalar()))


@Q.register("model_input_clean", "WITH " + O.BASE + f"""
SELECT split, {O.i64('COUNT(*)', 'rows')}, {O.i64('0', 'nulls')},
  {O.i64('COUNT(*) FILTER (dep_daypart IS NULL)', 'missing_daypart')},
  {O.i64('COUNT(*) FILTER (CRS_DEP_MINUTES IS NULL)', 'missing_minutes')} FROM base GROUP BY split""")
def q_model_input_clean(spark, sf_dir):
    cfg = MO.FIXTURE_MODEL
    x = MD.model_inputs(stages.with_aggregates(spark, sf_dir), cfg, keep=("split",))
    bad = F.filter(F.array(*[F.col(c).isNull() | (F.isnan(c) if c not in cfg.cat_cols else F.lit(False)) for c in cfg.feature_cols]), lambda b: b)
    nulls = F.sum(F.size(bad))
    return Q.present(x.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), nulls.alias("nulls"),
        F.count_if(F.col("dep_daypart") == MD.S.MISSING_KEY).alias("missing_daypart"),
        F.count_if(F.col("CRS_DEP_MINUTES") == MD.MISSING_NUMERIC).alias("missing_minutes")))


@Q.register("model_checks", "SELECT CAST(1 AS BIGINT) AS several_rounds, CAST(1 AS BIGINT) AS within_limit, CAST(1 AS BIGINT) AS learned")
def q_model_checks(spark, sf_dir):
    """More than one round is kept, within the limit, and the validation AUC is clearly above 0.5."""
    model = MO.fixture_model(spark, sf_dir)
    rounds = model.stages[-1].getNumTrees
    val = MO.evaluate_splits(model, stages.with_aggregates(spark, sf_dir), splits=("val",))
    return Q.present(val.select(F.lit(rounds > 1).alias("several_rounds"),
                                F.lit(rounds <= MO.FIXTURE_MODEL.max_iter).alias("within_limit"), (F.col("roc_auc") > 0.6).alias("learned")))


def _upkept(spark, sf_dir: str) -> str:
    """The state after three advances: the train days, the days of val, the rest; built once per session."""
    def build():
        root, base = _folder(spark, "upkeep"), stages.base_table(spark, sf_dir)
        edges = [stages.FIXTURE_SPLITS.train_end, stages.FIXTURE_SPLITS.val_end]
        day = F.col("flight_date")
        for part in (base.where(day <= edges[0]), base.where((day > edges[0]) & (day <= edges[1])), base.where(day > edges[1])):
            U.advance(spark, root, part)
        return root
    return stages._stage(spark, sf_dir, "upkeep", build)


def _upkeep_query(spec):
    def q(spark, sf_dir):
        """The daily feature table kept up in three steps; the twin is the one built at once."""
        return Q.present(U.features(spark, _upkept(spark, sf_dir), spec))
    return q


for _spec in MD.S.SPECS:
    Q.REGISTRY[f"upkeep_{_spec.name}"] = (_upkeep_query(_spec), Q.REGISTRY[f"rolling_{_spec.name}"][1])


_STEPS = [f"{s.name}_delay_rate_90d" for s in MD.S.SPECS]


@Q.register("model_rounds", "WITH " + O.BASE + ",\n" + O.with_aggs_cte() + ",\nsc AS (" + " UNION ALL ".join(
    f"SELECT {k} AS split, delayed_15 AS y, round({' + '.join(_STEPS[:k])}, 6) AS p FROM with_aggs WHERE split = 'val'"
    for k in range(1, len(_STEPS) + 1)) + ")" + Q.RANKING_SQL + f"""
SELECT {O.i64('split', 'round')}, {O.r6('CASE WHEN P > 0 AND N > 0 THEN auc_num / (P * N) END', 'roc_auc')},
  {O.i64('P', 'positives')}, {O.i64('N', 'negatives')}, {O.i64('thresholds')} FROM rk""")
def q_model_rounds(spark, sf_dir):
    """AUC of every round over margins that grow by one rate of the flight a round (what the choice of the best round runs on the forest's)."""
    rows = stages.with_aggregates(spark, sf_dir).where(F.col("split") == "val")
    sums = [F.round(sum((F.col(c) for c in _STEPS[1:k]), F.col(_STEPS[0])), 6) for k in range(1, len(_STEPS) + 1)]
    got = MD.round_aucs(rows.select(F.col("delayed_15").alias("label"), F.array(*sums).alias("margins")))
    return Q.present(got.select("round", "roc_auc", "positives", "negatives", "thresholds"))


@Q.register("score_consistency", Q._REQ_SQL + f"""
SELECT request_id, {O.i64('1', 'in_range')}, {O.i64('1', 'bucket_agrees')} FROM reqf""")
def q_score_consistency(spark, sf_dir):
    out = Q._scored_requests(spark, sf_dir)
    p, low, medium = F.col("probability"), MD.S.RISK_LOW_BELOW, MD.S.RISK_MEDIUM_BELOW
    low_edge = F.when(F.col("risk_bucket") == "Low", 0.0).when(F.col("risk_bucket") == "Medium", low).otherwise(medium)
    high_edge = F.when(F.col("risk_bucket") == "Low", low).when(F.col("risk_bucket") == "Medium", medium).otherwise(1.0)
    return Q.present(out.select("request_id", ((p > 0) & (p < 1)).alias("in_range"),
                                ((p >= low_edge) & (p < high_edge)).alias("bucket_agrees")))


@Q.register("contributions_check", Q._REQ_SQL + f"""
SELECT request_id, {O.i64('1', 'adds_up')}, {O.i64(str(len(MO.FIXTURE_MODEL.feature_cols)), 'features')} FROM reqf""")
def q_contributions_check(spark, sf_dir):
    """Base plus contributions is the log-odds of every request, to 1e-9."""
    out = Q._scored_requests(spark, sf_dir)
    total = F.aggregate("contrib", F.lit(0.0), lambda a, x: a + x)
    return Q.present(out.select("request_id", (F.abs(2 * F.col("margin") - F.col("base_value") - total) < 1e-9).alias("adds_up"),
                                F.size("contrib").alias("features")))


@Q.register("evidence_fields", Q._ENR_SQL + f""",
ups AS (SELECT request_id, count(*) FILTER (direction = 'up' AND rank <= 6) AS n_up, count(*) FILTER (direction = 'down' AND rank <= 6) AS n_down,
  max(CASE WHEN direction = 'up' AND rank = 1 THEN feature END) AS first_up,
  max(CASE WHEN direction = 'up' AND rank = 1 THEN abs(contribution) END) AS first_up_size FROM ranked GROUP BY request_id)
SELECT request_id, '{X.S.EVIDENCE_VERSION}' AS version, {O.r6('origin_delay_rate_30d', 'probability')}, OP_CARRIER AS carrier, ORIGIN AS origin, DEST AS dest,
  strftime(flight_date, '%Y-%m-%dT%H:%M:%S') AS flight_date, {O.i64('CRS_DEP_HOUR', 'hour')}, {O.i64('coalesce(n_up, 0)', 'n_up')},
  {O.i64('coalesce(n_down, 0)', 'n_down')}, first_up, {O.r6('first_up_size')}, {O.r6('sg', 'base_value')}
FROM enr LEFT JOIN ups USING (request_id)""")
def q_evidence_fields(spark, sf_dir):
    """The evidence documents, parsed again."""
    driver = "array<struct<feature:string,label:string,direction:string,shap:double,abs_shap:double>>"
    schema = ("version string, prediction struct<probability:double,risk_bucket:string>, flight struct<flight_date:string,carrier:string,"
              f"origin:string,dest:string,scheduled_departure_hour:int>, drivers struct<risk_up:{driver},risk_down:{driver}>, shap struct<base_value:double>")
    d = Q._explained_requests(spark, sf_dir).select("request_id", F.from_json("evidence", schema).alias("d"))
    return Q.present(d.select(
        "request_id", "d.version", "d.prediction.probability", "d.flight.carrier", "d.flight.origin", "d.flight.dest", "d.flight.flight_date",
        F.col("d.flight.scheduled_departure_hour").alias("hour"), F.size("d.drivers.risk_up").alias("n_up"), F.size("d.drivers.risk_down").alias("n_down"),
        F.try_element_at("d.drivers.risk_up.feature", F.lit(1)).alias("first_up"),
        F.try_element_at("d.drivers.risk_up.abs_shap", F.lit(1)).alias("first_up_size"), F.col("d.shap.base_value").alias("base_value")))


# ---------------------------------------------------------------------------
# Schema-only reads, null dates, stage checks, a saved model
# ---------------------------------------------------------------------------

_SCHEMAS = ("lineitem", "orders", "customer", "supplier", "nation")


@Q.register("schema_columns", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", column_name AS name FROM (DESCRIBE {t})" for t in _SCHEMAS))
def q_schema_columns(spark, sf_dir):
    """Column names from the footers."""
    rows = [(t, c) for t in _SCHEMAS for c in PQ.dataset_columns(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")]
    return spark.createDataFrame(rows, "table string, name string")


def _undated(spark, sf_dir):
    """The fixture with every seventh day of a month undated."""
    base = stages.base_table(spark, sf_dir)
    return base.withColumn("flight_date", F.when(F.col("day_of_month") % 7 != 0, F.col("flight_date")))


@Q.register("null_dates", "WITH " + O.BASE + f"""
SELECT OP_CARRIER, {O.i64('COUNT(*)', 'rows')} FROM base WHERE day_of_month % 7 <> 0 GROUP BY OP_CARRIER""")
def q_null_dates(spark, sf_dir):
    """Rows without a date leave the scope, also an open one."""
    left = scope_filter(_undated(spark, sf_dir), MD.S.ScopeConfig())
    return Q.present(left.groupBy("OP_CARRIER").agg(F.count(F.lit(1)).alias("rows")))


@Q.register("split_non_empty", "WITH " + O.BASE + f"""
SELECT split, {O.i64('COUNT(*)', 'rows')} FROM base GROUP BY split""")
def q_split_non_empty(spark, sf_dir):
    """The splits, checked to have rows."""
    checked = CK.require_splits_non_empty(stages.base_table(spark, sf_dir))
    return Q.present(checked.groupBy("split").agg(F.count(F.lit(1)).alias("rows")))


@Q.register("undated_count", "WITH " + O.BASE + f"""
SELECT {O.i64('COUNT(*) FILTER (day_of_month % 7 = 0)', 'undated')} FROM base""")
def q_undated_count(spark, sf_dir):
    """The number of undated rows that the check of a stage reports when it fails."""
    try:
        CK.require_no_nulls(_undated(spark, sf_dir), "flight_date", show_cols=["OP_CARRIER"])
        n = 0
    except CK.DataCheckError as e:
        n = int(str(e).split(" ", 1)[0])
    return spark.createDataFrame([(n,)], "undated long")


@Q.register("model_reload", "WITH " + O.BASE + f"""
SELECT split, {O.i64('COUNT(*)', 'rows')}, {O.i64('COUNT(*)', 'same')} FROM base WHERE split <> 'train' GROUP BY split""")
def q_model_reload(spark, sf_dir):
    """A saved and loaded model gives every val and test row the probability of the fitted one (E5)."""
    model, cfg, path = MO.fixture_model(spark, sf_dir), MO.FIXTURE_MODEL, _folder(spark, "model")
    MD.save(model, cfg, path)
    again, cfg_again = MD.load(path)
    rows = stages.with_aggregates(spark, sf_dir).where("split <> 'train'")
    once = MD.score(model, rows, cfg, keep=("split",)).withColumnRenamed("probability", "fitted")
    once = once.drop("features", "rawPrediction", "prediction", "margin", *[c for c in once.columns if "__" in c and not c.endswith("__raw")])
    both = MD.score(again, once, cfg_again, keep=("split", "fitted"))
    return Q.present(both.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("fitted") == F.col("probability")).alias("same")))


# ---------------------------------------------------------------------------
# Ordered target statistics and Shapley values over whole tables
# ---------------------------------------------------------------------------

_TS_CATS, _TS_ORDER = ("OP_CARRIER", "route"), ("flight_date", "OP_CARRIER", "ORIGIN", "DEST", "CRS_DEP_HOUR", "DISTANCE")


def _before(cat: str) -> str:
    over = f"OVER (PARTITION BY {cat} ORDER BY o GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"(coalesce(sum(delayed_15) {over}, 0) + (SELECT avg(delayed_15) FROM rows_)) / (count(*) {over} + 1.0)"


@Q.register("ordered_statistics", "WITH " + O.BASE + f""",
rows_ AS (SELECT *, substr(md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in _TS_ORDER)})), 1, 15) AS o
 FROM (SELECT * REPLACE (CAST(DISTANCE AS BIGINT) AS DISTANCE) FROM base) WHERE split = 'train'),
s AS (SELECT flight_date, OP_CARRIER, route, CRS_DEP_HOUR, {', '.join(f'{_before(c)} AS {c}_s' for c in _TS_CATS)} FROM rows_)
SELECT flight_date, OP_CARRIER, route, {O.i64('CRS_DEP_HOUR')}, {', '.join(O.r6(f'{c}_s', f'{c}__ots') for c in _TS_CATS)} FROM s""")
def q_ordered_statistics(spark, sf_dir):
    """Ordered target statistics of two categories for every train row."""
    train = stages.base_table(spark, sf_dir).where("split = 'train'").withColumn("DISTANCE", F.col("DISTANCE").cast("long"))
    got = EN.ordered_target_statistics(train, _TS_CATS, "delayed_15", EN.md5_order(*_TS_ORDER))
    return Q.present(got.select("flight_date", "OP_CARRIER", "route", "CRS_DEP_HOUR", *[f"{c}__ots" for c in _TS_CATS]))


# A tree over hour (0) and distance (1), the hour asked twice on two paths: node -> (feature, threshold, left, right).
_TREE = {0: (0, 12.0, 1, 2), 1: (1, 1500.0, 3, 4), 2: (1, 1000.0, 7, 8), 3: (0, 7.0, 5, 6)}
_LEAF_SQL = ("CASE WHEN h <= 12 THEN CASE WHEN d <= 1500 THEN CASE WHEN h <= 7 THEN 5 ELSE 6 END ELSE 4 END "
             "WHEN d <= 1000 THEN 7 ELSE 8 END")


def _tree_sql() -> str:
    """Values of the four games (hour, distance known or not) for every (h, d), and the Shapley values by their definition."""
    return f""",
pt AS (SELECT CAST(CRS_DEP_HOUR AS DOUBLE) AS h, CAST(DISTANCE AS DOUBLE) AS d, delayed_15 AS y FROM base WHERE CRS_DEP_HOUR IS NOT NULL AND DISTANCE IS NOT NULL),
lf AS (SELECT {_LEAF_SQL} AS leaf, count(*) * 1.0 AS n, avg(y) AS v FROM pt GROUP BY 1),
g AS (SELECT max(v) FILTER (leaf = 4) AS v4, max(v) FILTER (leaf = 5) AS v5, max(v) FILTER (leaf = 6) AS v6, max(v) FILTER (leaf = 7) AS v7, max(v) FILTER (leaf = 8) AS v8,
  sum(n) FILTER (leaf IN (4, 5, 6)) / sum(n) AS early, sum(n) FILTER (leaf IN (5, 6)) / sum(n) FILTER (leaf IN (4, 5, 6)) AS near_early,
  sum(n) FILTER (leaf = 5) / sum(n) FILTER (leaf IN (5, 6)) AS first_, sum(n) FILTER (leaf = 7) / sum(n) FILTER (leaf IN (7, 8)) AS near_late FROM lf),
q AS (SELECT DISTINCT h, d FROM pt),
games AS (SELECT h, d,
  near_early * (first_ * v5 + (1 - first_) * v6) + (1 - near_early) * v4 AS early_0, near_late * v7 + (1 - near_late) * v8 AS late_0,
  CASE WHEN d <= 1500 THEN first_ * v5 + (1 - first_) * v6 ELSE v4 END AS early_d, CASE WHEN d <= 1000 THEN v7 ELSE v8 END AS late_d,
  CASE WHEN h <= 7 THEN near_early * v5 + (1 - near_early) * v4 WHEN h <= 12 THEN near_early * v6 + (1 - near_early) * v4 ELSE near_late * v7 + (1 - near_late) * v8 END AS known_h,
  CASE ({_LEAF_SQL}) WHEN 4 THEN v4 WHEN 5 THEN v5 WHEN 6 THEN v6 WHEN 7 THEN v7 ELSE v8 END AS known_hd, early FROM q, g),
v AS (SELECT h, d, early * early_0 + (1 - early) * late_0 AS v0, early * early_d + (1 - early) * late_d AS vd, known_h AS vh, known_hd AS vhd FROM games)"""


@Q.register("shapley_values", "WITH " + O.BASE + _tree_sql() + f"""
SELECT {O.r6('h', 'hour')}, {O.r6('d', 'distance')}, {O.r6('v0', 'base_value')},
  {O.r6('((vh - v0) + (vhd - vd)) / 2', 'hour_value')}, {O.r6('((vd - v0) + (vhd - vh)) / 2', 'distance_value')} FROM v""")
def q_shapley_values(spark, sf_dir):
    """Exact Shapley values of every hour and distance flown, for a tree whose leaf values and weights are those of the flights (H1)."""
    points = stages.base_table(spark, sf_dir).select(F.col("CRS_DEP_HOUR").cast("double").alias("h"), F.col("DISTANCE").cast("double").alias("d"), "delayed_15").dropna()
    leaves = {r.leaf: r for r in points.groupBy(F.expr(_LEAF_SQL).alias("leaf")).agg(F.count(F.lit(1)).alias("n"), F.avg("delayed_15").alias("v")).collect()}
    size = max(leaves) + 1
    forest = {"w": np.ones(1), **{k: np.zeros((1, size), t) for k, t in (("pred", float), ("thr", float), ("cover", float), ("feat", int))},
              "left": np.full((1, size), -1), "right": np.full((1, size), -1)}
    for leaf, r in leaves.items():
        forest["pred"][0, leaf], forest["cover"][0, leaf] = r.v, r.n
    for node in sorted(_TREE, reverse=True):
        f, at, left, right = _TREE[node]
        forest["feat"][0, node], forest["thr"][0, node], forest["left"][0, node], forest["right"][0, node] = f, at, left, right
        forest["cover"][0, node] = forest["cover"][0, left] + forest["cover"][0, right]
    bc = spark.sparkContext.broadcast(forest)

    @F.pandas_udf("array<double>")
    def explain(h: pd.Series, d: pd.Series) -> pd.Series:
        values, base = MD.shapley_values(np.stack([h, d], axis=1), bc.value)
        return pd.Series(list(np.column_stack([base, values])), dtype=object)

    got = points.select("h", "d").distinct().withColumn("s", explain("h", "d"))
    return Q.present(got.select(F.col("h").alias("hour"), F.col("d").alias("distance"), F.col("s")[0].alias("base_value"),
                                F.col("s")[1].alias("hour_value"), F.col("s")[2].alias("distance_value")))
