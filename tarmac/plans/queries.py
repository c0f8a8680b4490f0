"""Query registry: name -> (Spark plan builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)`` and reads the driver tables through
the fixture view, so its work grows with the tables.  Results are presented
with one convention on both sides: integers as BIGINT, doubles rounded to 6
decimals, arrays as joined strings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rolling
from ..schemas import SPECS, WINDOWS, aggregate_columns
from . import oracle as O
from . import stages

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def present(df: DataFrame, rounded=()) -> DataFrame:
    """Integers -> bigint, floating -> double rounded to 6 (columns in ``rounded`` are), arrays -> joined text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if f.name in rounded:
            cols.append(c)
            continue
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(t, T.BooleanType):
            c = c.cast("bigint")
        elif isinstance(t, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "|")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Labels (F1 F2 P6 P10 A2)
# ---------------------------------------------------------------------------

_LABEL_COLS = ["flight_date", "YEAR", "MONTH", "OP_CARRIER", "ORIGIN", "DEST", "arr_delay_minutes", "delayed_15"]


@register("label_flights", "WITH " + O.LABELED + f"""
SELECT flight_date, {O.i64('YEAR')}, {O.i64('MONTH')}, OP_CARRIER, ORIGIN, DEST,
  {O.r6('arr_delay_minutes')}, {O.i64('delayed_15')} FROM labeled""")
def q_label_flights(spark, sf_dir):
    return present(stages.labeled_flights(spark, sf_dir).select(*_LABEL_COLS))


@register("label_rate_by_carrier", "WITH " + O.LABELED + f"""
SELECT OP_CARRIER, {O.i64('COUNT(*)', 'flights')}, {O.i64('SUM(delayed_15)', 'delayed')},
  {O.r6('AVG(CAST(delayed_15 AS DOUBLE))', 'delay_rate')}
FROM labeled GROUP BY OP_CARRIER""")
def q_label_rate_by_carrier(spark, sf_dir):
    lab = stages.labeled_flights(spark, sf_dir)
    return present(lab.groupBy("OP_CARRIER").agg(
        F.count(F.lit(1)).alias("flights"), F.sum("delayed_15").alias("delayed"),
        F.avg(F.col("delayed_15").cast("double")).alias("delay_rate")))


# ---------------------------------------------------------------------------
# Scheduled times
# ---------------------------------------------------------------------------

@register("hhmm_minutes", "WITH " + O.TYPED + f"""
SELECT {O.i64('CRS_DEP_TIME')}, {O.i64('CRS_ARR_TIME')}, {O.r6('CRS_DEP_MINUTES')}, {O.r6('CRS_ARR_MINUTES')},
  {O.i64('CRS_DEP_HOUR')}, {O.i64('CRS_ARR_HOUR')}, {O.i64('COUNT(*)', 'flights')}
FROM typed GROUP BY ALL""")
def q_hhmm_minutes(spark, sf_dir):
    t = stages.typed_flights(spark, sf_dir)
    return present(t.groupBy("CRS_DEP_TIME", "CRS_ARR_TIME", "CRS_DEP_MINUTES", "CRS_ARR_MINUTES",
                             "CRS_DEP_HOUR", "CRS_ARR_HOUR").agg(F.count(F.lit(1)).alias("flights")))


@register("daypart_counts", "WITH " + O.TYPED + f"""
SELECT {O.DAYPART.format(h='CRS_DEP_HOUR')} AS dep_daypart, {O.i64('COUNT(*)', 'flights')},
  {O.i64('MIN(CRS_DEP_HOUR)', 'min_hour')}, {O.i64('MAX(CRS_DEP_HOUR)', 'max_hour')}
FROM typed GROUP BY 1""")
def q_daypart_counts(spark, sf_dir):
    from ..functions.timeofday import daypart
    t = stages.typed_flights(spark, sf_dir)
    return present(t.groupBy(daypart("CRS_DEP_HOUR").alias("dep_daypart")).agg(
        F.count(F.lit(1)).alias("flights"), F.min("CRS_DEP_HOUR").alias("min_hour"),
        F.max("CRS_DEP_HOUR").alias("max_hour")))


# ---------------------------------------------------------------------------
# Calendar and base features
# ---------------------------------------------------------------------------

_BASE_SQL_COLS = (
    f"flight_date, {O.i64('YEAR')}, {O.i64('MONTH')}, {O.i64('DAY_OF_WEEK')}, {O.i64('is_weekend')}, "
    f"{O.i64('week_of_year')}, {O.i64('day_of_month')}, OP_CARRIER, ORIGIN, DEST, route, dep_daypart, "
    f"{O.r6('DISTANCE')}, {O.r6('CRS_DEP_MINUTES')}, {O.r6('CRS_ARR_MINUTES')}, {O.i64('CRS_DEP_HOUR')}, "
    f"{O.i64('CRS_ARR_HOUR')}, {O.i64('delayed_15')}")


@register("calendar_features", "WITH " + O.BASE + f"""
SELECT flight_date, {O.i64('YEAR')}, {O.i64('MONTH')}, {O.i64('DAY_OF_WEEK')}, {O.i64('is_weekend')},
  {O.i64('week_of_year')}, {O.i64('day_of_month')}, {O.i64('COUNT(*)', 'flights')}
FROM base GROUP BY ALL""")
def q_calendar_features(spark, sf_dir):
    b = stages.base_table(spark, sf_dir)
    return present(b.groupBy("flight_date", "YEAR", "MONTH", "DAY_OF_WEEK", "is_weekend", "week_of_year",
                             "day_of_month").agg(F.count(F.lit(1)).alias("flights")))


@register("base_features", "WITH " + O.BASE + f"\nSELECT {_BASE_SQL_COLS}, split FROM base")
def q_base_features(spark, sf_dir):
    return present(stages.base_table(spark, sf_dir))


# ---------------------------------------------------------------------------
# Daily collapse (A1) and rolling tables (W1 W2 A3), one pair per spec
# ---------------------------------------------------------------------------

def _daily_query(spec):
    def q(spark, sf_dir):
        return present(rolling.daily_table(stages.base_table(spark, sf_dir), spec))
    keys = ", ".join(k if k != "CRS_DEP_HOUR" else O.i64(k) for k in spec.keys)
    sql = "WITH " + O.BASE + f""",
{O.daily_cte(spec)}
SELECT {keys}, flight_date, {O.i64('n')}, {O.i64('s')} FROM daily_{spec.name}"""
    return q, sql


def _rolling_query(spec):
    def q(spark, sf_dir):
        return present(rolling.rolling_table(stages.base_table(spark, sf_dir), spec))
    keys = ", ".join(k if k != "CRS_DEP_HOUR" else O.i64(k) for k in spec.keys)
    cols = []
    for w in WINDOWS:
        cols += [O.r6(f"{spec.name}_freq_{w}d"), O.r6(f"{spec.name}_delay_rate_{w}d")]
    sql = "WITH " + O.BASE + ",\n" + O.rolling_cte(spec) + f"""
SELECT {keys}, flight_date, {', '.join(cols)} FROM roll_{spec.name}"""
    return q, sql


for _spec in SPECS:
    _q, _sql = _daily_query(_spec)
    REGISTRY[f"daily_collapse_{_spec.name}"] = (_q, _sql)
    _q, _sql = _rolling_query(_spec)
    REGISTRY[f"rolling_{_spec.name}"] = (_q, _sql)


# ---------------------------------------------------------------------------
# Join-back of all specs
# ---------------------------------------------------------------------------

_AGG_SQL = ", ".join(O.r6(c) for c in aggregate_columns())


@register("flights_with_aggs", "WITH " + O.BASE + ",\n" + O.with_aggs_cte() + f"""
SELECT {_BASE_SQL_COLS}, split, {_AGG_SQL} FROM with_aggs""")
def q_flights_with_aggs(spark, sf_dir):
    return present(stages.with_aggregates(spark, sf_dir, decimals=6), rounded=aggregate_columns())


@register("rolling_origin_30d", "WITH " + O.BASE + ",\n" + O.rolling_cte(SPECS[0], (30,)) + f"""
SELECT flight_date, ORIGIN, {O.i64('delayed_15')}, {O.r6('origin_freq_30d')}, {O.r6('origin_delay_rate_30d')}
FROM sbase LEFT JOIN roll_origin USING (ORIGIN, flight_date)""")
def q_rolling_origin_30d(spark, sf_dir):
    """The minimum end-to-end slice: label -> A2 -> A1 -> W1(30) -> A3 -> J1."""
    wa = stages.with_aggregates(spark, sf_dir, specs=SPECS[:1], windows=(30,))
    return present(wa.select("flight_date", "ORIGIN", "delayed_15", "origin_freq_30d", "origin_delay_rate_30d"))


# ---------------------------------------------------------------------------
# Feature store, lookup tables, requests
# ---------------------------------------------------------------------------

from ..operators import store as ST  # noqa: E402
from ..sources.fixture import FIXTURE_SUPPORTED_AIRPORTS, FIXTURE_SUPPORTED_CARRIERS  # noqa: E402

_STORE_SQL = "WITH " + O.BASE + ",\n" + O.store_cte()
_REQ_SQL = _STORE_SQL + ",\n" + O.requests_cte(FIXTURE_SUPPORTED_AIRPORTS, FIXTURE_SUPPORTED_CARRIERS)
_KEYS_SQL = f"flight_date, ORIGIN, DEST, OP_CARRIER, route, {O.i64('CRS_DEP_HOUR')}"


@register("feature_store", _STORE_SQL + f"\nSELECT {_KEYS_SQL}, {_AGG_SQL} FROM store")
def q_feature_store(spark, sf_dir):
    return present(stages.feature_store(spark, sf_dir, decimals=6), rounded=aggregate_columns())


@register("store_profile", _STORE_SQL + f"""
SELECT {O.i64('COUNT(*)', 'rows')}, {O.i64(str(len(aggregate_columns())), 'agg_cols')},
  MIN(flight_date) AS date_min, MAX(flight_date) AS date_max,
  {O.r6('(SELECT sg FROM sstats)', 'global_rate')} FROM store""")
def q_store_profile(spark, sf_dir):
    store = stages.feature_store(spark, sf_dir)
    prof = store.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(aggregate_columns())).alias("agg_cols"),
                     F.min("flight_date").alias("date_min"), F.max("flight_date").alias("date_max"))
    return present(prof.withColumn("global_rate", F.lit(stages.store_stats(spark, sf_dir)["global_rate"])))


@register("dedup_keep_first", _STORE_SQL + f"""
SELECT flight_date, ORIGIN, DEST, OP_CARRIER, route, {O.i64('CRS_DEP_HOUR')}, {_AGG_SQL} FROM (
 SELECT *, row_number() OVER (PARTITION BY flight_date, ORIGIN ORDER BY DEST, OP_CARRIER, route, CRS_DEP_HOUR) AS rn
 FROM store) WHERE rn = 1""")
def q_dedup_keep_first(spark, sf_dir):
    from ..operators.sets import keep_first
    store = stages.feature_store(spark, sf_dir)
    return present(keep_first(store, ["flight_date", "ORIGIN"], ["DEST", "OP_CARRIER", "route", "CRS_DEP_HOUR"]))


_REQ_COLS_SQL = (
    f"request_id, flight_date, {O.i64('YEAR')}, {O.i64('MONTH')}, {O.i64('DAY_OF_WEEK')}, {O.i64('is_weekend')}, "
    f"{O.i64('week_of_year')}, {O.i64('day_of_month')}, OP_CARRIER, ORIGIN, DEST, route, dep_daypart, "
    f"{O.r6('DISTANCE')}, {O.i64('CRS_DEP_HOUR')}, {O.r6('CRS_DEP_MINUTES')}, {O.i64('CRS_ARR_HOUR')}, "
    f"{O.r6('CRS_ARR_MINUTES')}, {O.i64('is_valid')}, invalid_reason")
_own_ctes, _own_from, _own_cols = O.lookup_own_sql()
_ov_ctes, _ov_from, _ov_cols = O.lookup_overlay_sql()
_cp_cte, _cp_from, _cp_cols = O.lookup_composite_sql()


def _requests(spark, sf_dir):
    return stages.request_table(spark, sf_dir)


@register("requests_enriched", _REQ_SQL + ",\n" + _own_ctes + f"""
SELECT {', '.join('rql.' + c if ' AS ' not in c else c.replace('CAST(', 'CAST(rql.', 1) for c in _REQ_COLS_SQL.split(', '))}, rql.lookup_date, {_own_cols} {_own_from}""")
def q_requests_enriched(spark, sf_dir):
    store = stages.feature_store(spark, sf_dir)
    return present(ST.enrich_requests(_requests(spark, sf_dir), store, stages.store_stats(spark, sf_dir), mode="own",
                                      lookups=stages.lookups(spark, sf_dir, "own")))


@register("lookup_own", _REQ_SQL + ",\n" + _own_ctes + f"""
SELECT rql.request_id, rql.lookup_date, {_own_cols} {_own_from}""")
def q_lookup_own(spark, sf_dir):
    store = stages.feature_store(spark, sf_dir)
    out = ST.enrich_requests(_requests(spark, sf_dir), store, stages.store_stats(spark, sf_dir), mode="own", lookups=stages.lookups(spark, sf_dir, "own"))
    return present(out.select("request_id", "lookup_date", *aggregate_columns()))


@register("lookup_overlay", _REQ_SQL + ",\n" + _ov_ctes + f"""
SELECT rql.request_id, rql.lookup_date, {_ov_cols} {_ov_from}""")
def q_lookup_overlay(spark, sf_dir):
    store = stages.feature_store(spark, sf_dir)
    out = ST.enrich_requests(_requests(spark, sf_dir), store, stages.store_stats(spark, sf_dir), mode="overlay",
                             lookups=stages.lookups(spark, sf_dir, "overlay"))
    return present(out.select("request_id", "lookup_date", *aggregate_columns()))


@register("lookup_composite", _REQ_SQL + ",\n" + _cp_cte + f"""
SELECT rql.request_id, rql.lookup_date, {_cp_cols} {_cp_from}""")
def q_lookup_composite(spark, sf_dir):
    store = stages.feature_store(spark, sf_dir)
    out = ST.lookup_composite(_requests(spark, sf_dir), store, stages.store_stats(spark, sf_dir))
    return present(out.select("request_id", "lookup_date", *aggregate_columns()))


# ---------------------------------------------------------------------------
# Scope, split and profiles
# ---------------------------------------------------------------------------

from ..operators import scope as SC  # noqa: E402
from ..sources.fixture import FIXTURE_SCOPE  # noqa: E402


def _in(vals):
    return ", ".join(f"'{v}'" for v in vals)


_SCOPE_WHERE = (
    f"flight_date BETWEEN DATE '{FIXTURE_SCOPE.start}' AND DATE '{FIXTURE_SCOPE.end}' "
    f"AND upper(trim(OP_CARRIER)) IN ({_in(FIXTURE_SCOPE.carriers)}) "
    f"AND upper(trim(ORIGIN)) IN ({_in(FIXTURE_SCOPE.origins)}) AND upper(trim(DEST)) IN ({_in(FIXTURE_SCOPE.dests)})")


@register("scope_filter", "WITH " + O.LABELED + f"""
SELECT flight_date, {O.i64('YEAR')}, {O.i64('MONTH')}, upper(trim(OP_CARRIER)) AS OP_CARRIER,
  upper(trim(ORIGIN)) AS ORIGIN, upper(trim(DEST)) AS DEST, {O.r6('arr_delay_minutes')}, {O.i64('delayed_15')}
FROM labeled WHERE {_SCOPE_WHERE}""")
def q_scope_filter(spark, sf_dir):
    return present(SC.scope_filter(stages.labeled_flights(spark, sf_dir), FIXTURE_SCOPE).select(*_LABEL_COLS))


@register("scope_profile", "WITH " + O.LABELED + f"""
SELECT {O.i64('COUNT(*)', 'rows')}, {O.r6('AVG(CAST(delayed_15 AS DOUBLE))', 'delay_rate')},
  MIN(flight_date) AS date_min, MAX(flight_date) AS date_max,
  array_to_string(list_sort(list_distinct(list(upper(trim(OP_CARRIER))))), '|') AS carriers,
  array_to_string(list_sort(list_distinct(list(upper(trim(ORIGIN))))), '|') AS origins,
  array_to_string(list_sort(list_distinct(list(upper(trim(DEST))))), '|') AS dests
FROM labeled WHERE {_SCOPE_WHERE}""")
def q_scope_profile(spark, sf_dir):
    return present(SC.scope_profile(SC.scope_filter(stages.labeled_flights(spark, sf_dir), FIXTURE_SCOPE)))


@register("time_split", "WITH " + O.SPLIT + f"""
SELECT flight_date, OP_CARRIER, ORIGIN, DEST, {O.i64('delayed_15')}, split FROM split_rows""")
def q_time_split(spark, sf_dir):
    return present(stages.split_flights(spark, sf_dir).select(
        "flight_date", "OP_CARRIER", "ORIGIN", "DEST", "delayed_15", "split"))


@register("split_summary", "WITH " + O.SPLIT + f"""
SELECT split, {O.i64('COUNT(*)', 'rows')}, {O.r6('AVG(CAST(delayed_15 AS DOUBLE))', 'delay_rate')},
  MIN(flight_date) AS date_min, MAX(flight_date) AS date_max FROM split_rows GROUP BY split""")
def q_split_summary(spark, sf_dir):
    return present(SC.split_summary(stages.split_flights(spark, sf_dir)))


@register("year_month_preview", "WITH " + O.LABELED + f"""
SELECT {O.i64('YEAR')}, {O.i64('MONTH')} FROM (SELECT DISTINCT YEAR, MONTH FROM labeled) ORDER BY 1, 2 LIMIT 10""")
def q_year_month_preview(spark, sf_dir):
    return present(SC.year_month_preview(stages.labeled_flights(spark, sf_dir)))


@register("ingest_profile", "WITH " + O.TYPED + f"""
SELECT {O.i64('COUNT(*)', 'rows')}, MIN(FL_DATE) AS date_min, MAX(FL_DATE) AS date_max FROM typed""")
def q_ingest_profile(spark, sf_dir):
    return present(SC.ingest_profile(stages.typed_flights(spark, sf_dir)).drop("columns"))


# ---------------------------------------------------------------------------
# Metrics over a deterministic score
# ---------------------------------------------------------------------------

from ..operators import metrics as M  # noqa: E402

_SCORED_SQL = ("WITH " + O.BASE + ",\n" + O.with_aggs_cte()
               + ",\nsc AS (SELECT split, delayed_15 AS y, round(origin_delay_rate_30d, 6) AS p FROM with_aggs)")
RANKING_SQL = """,
thr AS (SELECT split, p, SUM(y) AS tp, COUNT(*) - SUM(y) AS fp FROM sc WHERE p IS NOT NULL GROUP BY split, p),
cum AS (SELECT *, SUM(tp) OVER (PARTITION BY split ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS ctp,
                  SUM(fp) OVER (PARTITION BY split ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cfp FROM thr),
rk AS (SELECT split, CAST(SUM(tp) AS DOUBLE) AS P, CAST(SUM(fp) AS DOUBLE) AS N,
  SUM((CAST(ctp AS DOUBLE) - CAST(tp AS DOUBLE) / 2) * CAST(fp AS DOUBLE)) AS auc_num,
  SUM(CAST(tp AS DOUBLE) * CAST(ctp AS DOUBLE) / CAST(ctp + cfp AS DOUBLE)) AS ap_num, COUNT(*) AS thresholds
 FROM cum GROUP BY split)"""
_CUM_SQL = _SCORED_SQL + RANKING_SQL


def _scored(spark, sf_dir):
    return stages.scored_fixture(stages.with_aggregates(spark, sf_dir))


@register("roc_auc", _CUM_SQL + f"""
SELECT split, {O.r6('CASE WHEN P > 0 AND N > 0 THEN auc_num / (P * N) END', 'roc_auc')},
  {O.i64('P', 'positives')}, {O.i64('N', 'negatives')}, {O.i64('thresholds')} FROM rk""")
def q_roc_auc(spark, sf_dir):
    r = M.ranking_metrics(_scored(spark, sf_dir), group_cols=["split"])
    return present(r.select("split", "roc_auc", "positives", "negatives", "thresholds"))


@register("average_precision", _CUM_SQL + f"""
SELECT split, {O.r6('CASE WHEN P > 0 THEN ap_num / P END', 'average_precision')} FROM rk""")
def q_average_precision(spark, sf_dir):
    r = M.ranking_metrics(_scored(spark, sf_dir), group_cols=["split"])
    return present(r.select("split", "average_precision"))


@register("brier", _SCORED_SQL + f"""
SELECT split, {O.r6('AVG((p - y) * (p - y))', 'brier')} FROM sc GROUP BY split""")
def q_brier(spark, sf_dir):
    return present(M.brier(_scored(spark, sf_dir), group_cols=["split"]))


@register("confusion_matrix", _SCORED_SQL + f"""
SELECT split, {O.i64('COUNT(*) FILTER (WHERE y = 0 AND NOT p >= 0.5)', 'tn')},
  {O.i64('COUNT(*) FILTER (WHERE y = 0 AND p >= 0.5)', 'fp')},
  {O.i64('COUNT(*) FILTER (WHERE y = 1 AND NOT p >= 0.5)', 'fn')},
  {O.i64('COUNT(*) FILTER (WHERE y = 1 AND p >= 0.5)', 'tp')} FROM sc GROUP BY split""")
def q_confusion_matrix(spark, sf_dir):
    return present(M.confusion_matrix(_scored(spark, sf_dir), threshold=0.5, group_cols=["split"]))


@register("confusion_matrix_t025", _SCORED_SQL + f"""
SELECT split, {O.i64('COUNT(*) FILTER (WHERE y = 0 AND NOT p >= 0.25)', 'tn')},
  {O.i64('COUNT(*) FILTER (WHERE y = 0 AND p >= 0.25)', 'fp')},
  {O.i64('COUNT(*) FILTER (WHERE y = 1 AND NOT p >= 0.25)', 'fn')},
  {O.i64('COUNT(*) FILTER (WHERE y = 1 AND p >= 0.25)', 'tp')} FROM sc GROUP BY split""")
def q_confusion_matrix_t025(spark, sf_dir):
    return present(M.confusion_matrix(_scored(spark, sf_dir), threshold=0.25, group_cols=["split"]))


@register("evaluation", _CUM_SQL + f""",
other AS (SELECT split, AVG((p - y) * (p - y)) AS brier,
  COUNT(*) FILTER (WHERE y = 0 AND NOT p >= 0.5) AS tn, COUNT(*) FILTER (WHERE y = 0 AND p >= 0.5) AS fp,
  COUNT(*) FILTER (WHERE y = 1 AND NOT p >= 0.5) AS fn, COUNT(*) FILTER (WHERE y = 1 AND p >= 0.5) AS tp
 FROM sc GROUP BY split)
SELECT rk.split, {O.r6('CASE WHEN P > 0 AND N > 0 THEN auc_num / (P * N) END', 'roc_auc')},
  {O.r6('CASE WHEN P > 0 THEN ap_num / P END', 'average_precision')}, {O.i64('P', 'positives')},
  {O.i64('N', 'negatives')}, {O.i64('thresholds')}, {O.i64('tn')}, {O.i64('fp')}, {O.i64('fn')}, {O.i64('tp')},
  {O.r6('brier')}, 0.5 AS threshold FROM rk JOIN other USING (split)""")
def q_evaluation(spark, sf_dir):
    return present(M.evaluate(_scored(spark, sf_dir), threshold=0.5, group_cols=["split"]))


@register("class_weights", _SCORED_SQL + f""",
cw AS (SELECT y, COUNT(*) AS n FROM sc WHERE split = 'train' GROUP BY y)
SELECT {O.i64('y', 'label')}, {O.i64('n')}, {O.r6('(SELECT MAX(n) FROM cw) / n', 'weight')} FROM cw""")
def q_class_weights(spark, sf_dir):
    return present(M.class_weights(_scored(spark, sf_dir).where(F.col("split") == "train")))


@register("risk_buckets", _SCORED_SQL + f"""
SELECT split, CASE WHEN p < 0.2 THEN 'Low' WHEN p < 0.4 THEN 'Medium' WHEN p IS NOT NULL THEN 'High' END AS risk_bucket,
  {O.i64('COUNT(*)', 'rows')} FROM sc GROUP BY ALL""")
def q_risk_buckets(spark, sf_dir):
    from ..operators.explain import risk_bucket
    s = _scored(spark, sf_dir)
    return present(s.groupBy("split", risk_bucket("score").alias("risk_bucket")).agg(F.count(F.lit(1)).alias("rows")))


# ---------------------------------------------------------------------------
# Sampling (N1 N2)
# ---------------------------------------------------------------------------

from ..operators import sampling as SM  # noqa: E402

SAMPLE_CAP = 7001
UNIFORM_CAP = 5000


def _train_rows(spark, sf_dir):
    return stages.with_aggregates(spark, sf_dir).where(F.col("split") == "train")


@register("sample_sizes", _SCORED_SQL + f""",
cnt AS (SELECT y, COUNT(*) AS size FROM sc WHERE split = 'train' GROUP BY y),
tot AS (SELECT SUM(size) AS rows FROM cnt),
tgt AS (SELECT y, size, CASE WHEN rows > {SAMPLE_CAP}
   THEN least(greatest(1, CAST(round_even(size * {SAMPLE_CAP}.0 / rows, 0) AS BIGINT)), size) ELSE size END AS n
 FROM cnt, tot)
SELECT {O.i64('y', 'delayed_15')}, {O.i64('size')}, {O.i64('n')}, {O.i64('n', 'sampled')} FROM tgt""")
def q_sample_sizes(spark, sf_dir):
    train = _train_rows(spark, sf_dir)
    tgt = SM.target_sizes(train, SAMPLE_CAP, "delayed_15")
    got = SM.capped_sample(train, SAMPLE_CAP, "delayed_15").groupBy("delayed_15").agg(
        F.count(F.lit(1)).alias("sampled"))
    return present(tgt.join(got, "delayed_15", "left").fillna(0, ["sampled"]))


@register("uniform_sample_size", _SCORED_SQL + f"""
SELECT {O.i64('COUNT(*)', 'rows')}, {O.i64(str(UNIFORM_CAP), 'cap')}, {O.i64(f'least(COUNT(*), {UNIFORM_CAP})', 'sampled')}
FROM sc WHERE split = 'train'""")
def q_uniform_sample_size(spark, sf_dir):
    train = _train_rows(spark, sf_dir)
    rows = train.agg(F.count(F.lit(1)).alias("rows"))
    got = SM.capped_sample(train.drop("delayed_15"), UNIFORM_CAP, None).agg(F.count(F.lit(1)).alias("sampled"))
    return present(rows.withColumn("cap", F.lit(UNIFORM_CAP)).withColumn("sampled", got.scalar()))


@register("stratified_sample", None)
def q_stratified_sample(spark, sf_dir):
    """Sample members (rows-only check: members differ from any SQL draw, counts are checked above)."""
    return present(SM.capped_sample(_train_rows(spark, sf_dir), SAMPLE_CAP, "delayed_15"))


# ---------------------------------------------------------------------------
# Union by name
# ---------------------------------------------------------------------------

@register("union_by_name", "WITH " + O.BASE + f"""
SELECT {_BASE_SQL_COLS.replace('DISTANCE', 'DISTANCE')}, split FROM (
 SELECT * FROM base WHERE split = 'train'
 UNION ALL BY NAME SELECT * EXCLUDE (CRS_ARR_MINUTES, CRS_ARR_HOUR) FROM base WHERE split = 'val'
 UNION ALL BY NAME SELECT * EXCLUDE (DISTANCE) FROM base WHERE split = 'test')""")
def q_union_by_name(spark, sf_dir):
    from ..operators.sets import union_by_name
    b = stages.base_table(spark, sf_dir)
    parts = [b.where(F.col("split") == "train"),
             b.where(F.col("split") == "val").drop("CRS_ARR_MINUTES", "CRS_ARR_HOUR"),
             b.where(F.col("split") == "test").drop("DISTANCE")]
    return present(union_by_name(parts))


# ---------------------------------------------------------------------------
# Explanations over a deterministic contribution table
#   contribution of a rate feature = its looked-up value - the store's global rate
# ---------------------------------------------------------------------------

from ..operators import explain as X  # noqa: E402
from ..schemas import model_feature_columns  # noqa: E402

_FEATS = model_feature_columns()
_RATE_FEATS = [(i, c) for i, c in enumerate(_FEATS) if "_delay_rate_" in c]
_raw_ctes, _raw_from, _raw_cols = O.lookup_own_sql(rounded=False)
_ENR_SQL = _REQ_SQL + ",\n" + _raw_ctes + f""",
enr AS (SELECT rql.request_id, rql.flight_date, rql.OP_CARRIER, rql.ORIGIN, rql.DEST, rql.route, rql.CRS_DEP_HOUR,
               rql.DAY_OF_WEEK, rql.sg, {_raw_cols} {_raw_from}),
lng AS ({' UNION ALL '.join(
    f"SELECT request_id, '{c}' AS feature, {i} AS pos, CAST(round({c}, 6) AS VARCHAR) AS value, {c} - sg AS contribution FROM enr"
    for i, c in _RATE_FEATS)}),
ranked AS (SELECT * FROM (
 SELECT *, row_number() OVER (PARTITION BY request_id, direction ORDER BY abs(contribution) DESC, pos) AS rank
 FROM (SELECT *, CASE WHEN contribution > 0 THEN 'up' ELSE 'down' END AS direction FROM lng WHERE contribution <> 0)))"""

_PAT = r"^([a-z_]+)_(delay_rate|freq)_(\d+)d$"
_SPEC_CASE = "CASE regexp_extract(feature, '{p}', 1) {w} ELSE regexp_extract(feature, '{p}', 1) END".format(
    p=_PAT, w=" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in __import__('tarmac.schemas', fromlist=['x']).SPEC_LABELS.items()))
_LABEL_SQL = (f"CASE WHEN regexp_matches(feature, '{_PAT}') THEN {_SPEC_CASE} || CASE regexp_extract(feature, '{_PAT}', 2) "
              f"WHEN 'delay_rate' THEN ' delay rate (last ' ELSE ' flights observed (last ' END "
              f"|| regexp_extract(feature, '{_PAT}', 3) || ' days)' ELSE feature END")


def _enriched(spark, sf_dir):
    store = stages.feature_store(spark, sf_dir)
    enr = ST.enrich_requests(_requests(spark, sf_dir), store, stages.store_stats(spark, sf_dir), mode="own",
                             lookups=stages.lookups(spark, sf_dir, "own"))
    stats = stages.store_stats(spark, sf_dir)
    return enr, F.lit(stats["global_rate"])


def _long_contributions(enr, sg):
    items = [F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"),
                      F.round(F.col(c), 6).cast("string").alias("value"),
                      (F.col(c) - sg).alias("contribution")) for i, c in _RATE_FEATS]
    return enr.select("request_id", F.explode(F.array(*items)).alias("x")).select("request_id", "x.*")


@register("reason_codes", _REQ_SQL + """
SELECT request_id, array_to_string(list_slice(list_filter([
  CASE WHEN CRS_DEP_HOUR IS NOT NULL AND CRS_DEP_HOUR >= 18 THEN '""" + X.S.REASON_EVENING + """' END,
  CASE WHEN CRS_DEP_HOUR IS NOT NULL AND CRS_DEP_HOUR <= 7 THEN '""" + X.S.REASON_EARLY + """' END,
  CASE WHEN is_weekend = 1 THEN '""" + X.S.REASON_WEEKEND + """' END,
  CASE WHEN DISTANCE >= 1500 THEN '""" + X.S.REASON_LONG + """' END,
  CASE WHEN route IS NOT NULL THEN '""" + X.S.REASON_ROUTE + """' END], lambda x: x IS NOT NULL), 1, 4), '|') AS reasons
FROM reqf""")
def q_reason_codes(spark, sf_dir):
    req = _requests(spark, sf_dir)
    return present(req.select("request_id", X.reason_codes().alias("reasons")))


@register("feature_labels", _ENR_SQL + f"""
SELECT request_id, feature, {_LABEL_SQL} AS label, {O.r6('contribution')} FROM lng""")
def q_feature_labels(spark, sf_dir):
    enr, sg = _enriched(spark, sf_dir)
    lng = _long_contributions(enr, sg)
    cat = X.label_catalogue(spark, _FEATS)
    return present(X.with_labels(lng, cat).select("request_id", "feature", "label", "contribution"))


@register("contribution_topk", _ENR_SQL + f"""
SELECT request_id, feature, direction, {O.i64('rank')}, {O.r6('contribution')} FROM ranked WHERE rank <= 8""")
def q_contribution_topk(spark, sf_dir):
    enr, sg = _enriched(spark, sf_dir)
    top = X.top_k_long(_long_contributions(enr, sg), "request_id", k=8)
    return present(top.select("request_id", "feature", "direction", "rank", "contribution"))


_BULLETS_SQL = _ENR_SQL + f""",
lbl AS (SELECT *, {_LABEL_SQL} AS label FROM ranked),
head AS (SELECT request_id, round(origin_delay_rate_30d * 1000) AS t, origin_delay_rate_30d AS p,
  OP_CARRIER, ORIGIN, DEST, flight_date, CRS_DEP_HOUR FROM enr),
lines AS (
 SELECT request_id, 1 AS ord, 'Predicted delay risk is ' || CAST(CAST(t AS BIGINT) // 10 AS VARCHAR) || '.'
   || CAST(CAST(t AS BIGINT) % 10 AS VARCHAR) || '% (bucket: '
   || CASE WHEN p < 0.2 THEN 'Low' WHEN p < 0.4 THEN 'Medium' ELSE 'High' END || ').' AS line FROM head
 UNION ALL SELECT request_id, 2, 'Flight inputs: ' || OP_CARRIER || ' ' || ORIGIN || '→' || DEST || ' on '
   || strftime(flight_date, '%Y-%m-%dT%H:%M:%S') || ' departing around hour ' || CAST(CRS_DEP_HOUR AS VARCHAR) || '.' FROM head
 UNION ALL SELECT request_id, 3, 'Historical aggregates were looked up using date: '
   || strftime((SELECT max_date FROM sstats), '%Y-%m-%d %H:%M:%S') || '.' FROM head
 UNION ALL SELECT request_id, 10 + rank, 'Risk ↑: ' || label || ' = ' || value || ' (feature: ' || feature || ').'
   FROM lbl WHERE direction = 'up' AND rank <= 3
 UNION ALL SELECT request_id, 20 + rank, 'Risk ↓: ' || label || ' = ' || value || ' (feature: ' || feature || ').'
   FROM lbl WHERE direction = 'down' AND rank <= 2)"""


@register("evidence_bullets", _BULLETS_SQL + """
SELECT request_id, string_agg(line, '|' ORDER BY ord) AS bullets FROM (
 SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS k FROM lines) WHERE k <= 6 GROUP BY request_id""")
def q_evidence_bullets(spark, sf_dir):
    out = _explained_requests(spark, sf_dir)
    return present(out.select("request_id", "bullets"))


def _explained_requests(spark, sf_dir):
    enr, sg = _enriched(spark, sf_dir)
    max_date = F.lit(stages.store_stats(spark, sf_dir)["max_date"])
    packed = X.pack_contributions([c for _, c in _RATE_FEATS],
                                  [F.round(F.col(c), 6) for _, c in _RATE_FEATS],
                                  [F.col(c) - sg for _, c in _RATE_FEATS])
    out = enr.withColumns({"probability": F.col("origin_delay_rate_30d"),
                           "contributions": packed, "base_value": sg})
    out = out.withColumn("risk_bucket", X.risk_bucket("probability"))
    out = out.withColumns(X.explanation_columns("contributions", k=6))
    # A scalar subquery may not sit inside a higher-order function: project it first.
    out = out.withColumn("lookup_text", X.lookup_meta_text(max_date))
    lookup_text = F.col("lookup_text")
    return out.withColumns({
        "bullets": X.bullets(lookup_text=lookup_text),
        "evidence": X.evidence(lookup_text=lookup_text),
    })


@register("evidence_documents", None)
def q_evidence_documents(spark, sf_dir):
    """Evidence JSON per request (rows-only: JSON text formatting is engine-specific)."""
    return _explained_requests(spark, sf_dir).select("request_id", "evidence")


# ---------------------------------------------------------------------------
# Model: training, scoring, contributions (E1-E5 H1) -- rows-only checks
# ---------------------------------------------------------------------------

from . import modeling as MO  # noqa: E402


def _scored_requests(spark, sf_dir):
    model = MO.fixture_model(spark, sf_dir)
    return MO.score_requests(spark, _requests(spark, sf_dir), stages.feature_store(spark, sf_dir), model,
                             stats=stages.store_stats(spark, sf_dir), lookups=stages.lookups(spark, sf_dir, "own"))


@register("model_evaluation", None)
def q_model_evaluation(spark, sf_dir):
    """AUC / AP / Brier / confusion of the fitted trees on val and test (values are model-specific)."""
    model = MO.fixture_model(spark, sf_dir)
    return present(MO.evaluate_splits(model, stages.with_aggregates(spark, sf_dir)))


@register("score_batch", None)
def q_score_batch(spark, sf_dir):
    out = _scored_requests(spark, sf_dir)
    return present(out.select("request_id", "is_valid", "probability", "risk_bucket", "reasons"))


@register("contributions", None)
def q_contributions(spark, sf_dir):
    """Per-request path contributions; ``check`` = log-odds - base - sum (should be ~0)."""
    out = _scored_requests(spark, sf_dir)
    total = F.aggregate("contrib", F.lit(0.0), lambda a, x: a + x)
    log_odds = F.log(F.col("probability") / (1 - F.col("probability")))
    return present(out.select(
        "request_id", "base_value", total.alias("contribution_sum"),
        (log_odds - F.col("base_value") - total).alias("check"),
        F.transform("top_positive", lambda d: d["feature"]).alias("top_up"),
        F.transform("top_negative", lambda d: d["feature"]).alias("top_down")))


@register("explain_batch", None)
def q_explain_batch(spark, sf_dir):
    out = _scored_requests(spark, sf_dir)
    return out.select("request_id", "probability", "risk_bucket", "evidence", F.array_join("bullets", "|").alias("bullets"))


# ---------------------------------------------------------------------------
# Text coercions on data-derived text
# ---------------------------------------------------------------------------

from ..functions import coerce as CO  # noqa: E402
from ..schemas import NA_TOKENS  # noqa: E402


def _as_text(f):
    """Fixture columns rendered as text, with NA tokens, padding, junk and both date formats by rule."""
    dom, d = F.col("DAY_OF_MONTH"), F.col("FL_DATE")
    delay = F.col("ARR_DELAY").cast("string")
    return f.select(
        F.when(dom == 13, F.lit("NA")).when(dom == 14, F.lit(" nan ")).when(dom == 15, F.concat(F.lit(" "), delay, F.lit(" ")))
         .when(dom == 16, F.concat(delay, F.lit("d"))).when(dom == 17, F.lit("1e1")).otherwise(delay).alias("delay_text"),
        F.when(F.col("MONTH") % 2 == 0, F.date_format(d, "yyyy-MM-dd"))
         .when(dom == 31, F.lit("junk")).otherwise(F.date_format(d, "M/d/yyyy")).alias("date_text"),
        F.when(dom == 7, F.concat(F.lit("\t"), F.col("OP_CARRIER"), F.lit(" "))).when(dom == 8, F.lit("NULL"))
         .otherwise(F.col("OP_CARRIER")).alias("carrier_text"),
        F.when(dom == 9, F.lit("5.5")).otherwise(F.col("CRS_DEP_TIME").cast("string")).alias("dep_text"))


_NA_SQL = ", ".join("'" + t + "'" for t in NA_TOKENS)
_WS = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_NUM_PAT = CO.NUMERIC_PATTERN


def _sql_num(x):
    s = _WS.format(x=x)
    return (f"CASE WHEN {s} IN ({_NA_SQL}) THEN NULL WHEN regexp_matches({x}, '{_NUM_PAT}') "
            f"THEN TRY_CAST({s} AS DOUBLE) END")


@register("text_coercion", "WITH " + O.FLIGHTS_SQL + f""",
txt AS (SELECT
  CASE WHEN DAY_OF_MONTH = 13 THEN 'NA' WHEN DAY_OF_MONTH = 14 THEN ' nan '
       WHEN DAY_OF_MONTH = 15 THEN ' ' || CAST(ARR_DELAY AS VARCHAR) || ' '
       WHEN DAY_OF_MONTH = 16 THEN CAST(ARR_DELAY AS VARCHAR) || 'd' WHEN DAY_OF_MONTH = 17 THEN '1e1'
       ELSE CAST(ARR_DELAY AS VARCHAR) END AS delay_text,
  CASE WHEN MONTH % 2 = 0 THEN strftime(FL_DATE, '%Y-%m-%d') WHEN DAY_OF_MONTH = 31 THEN 'junk'
       ELSE strftime(FL_DATE, '%-m/%-d/%Y') END AS date_text,
  CASE WHEN DAY_OF_MONTH = 7 THEN chr(9) || OP_CARRIER || ' ' WHEN DAY_OF_MONTH = 8 THEN 'NULL'
       ELSE OP_CARRIER END AS carrier_text,
  CASE WHEN DAY_OF_MONTH = 9 THEN '5.5' ELSE CAST(CRS_DEP_TIME AS VARCHAR) END AS dep_text
 FROM flights),
typed AS (SELECT {_sql_num('delay_text')} AS delay,
  COALESCE(CASE WHEN regexp_matches(date_text, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN TRY_CAST(date_text AS DATE) END,
           TRY_CAST(TRY_STRPTIME(date_text, '%m/%d/%Y') AS DATE)) AS flight_date,
  CASE WHEN {_WS.format(x='carrier_text')} IN ({_NA_SQL}) THEN NULL ELSE {_WS.format(x='carrier_text')} END AS carrier,
  CASE WHEN ({_sql_num('dep_text')}) = floor({_sql_num('dep_text')}) THEN CAST({_sql_num('dep_text')} AS INTEGER) END AS dep_time
 FROM txt)
SELECT {O.r6('delay')}, flight_date, carrier, {O.i64('dep_time')}, {O.i64('COUNT(*)', 'rows')} FROM typed GROUP BY ALL""")
def q_text_coercion(spark, sf_dir):
    t = _as_text(stages.flights(spark, sf_dir))
    typed = t.select(
        CO.to_double(CO.null_if_na_token("delay_text")).alias("delay"),
        CO.to_date_lenient("date_text").alias("flight_date"),
        CO.clean_text("carrier_text").alias("carrier"),
        CO.to_integral(CO.null_if_na_token("dep_text"), T.IntegerType()).alias("dep_time"))
    return present(typed.groupBy("delay", "flight_date", "carrier", "dep_time").agg(F.count(F.lit(1)).alias("rows")))
