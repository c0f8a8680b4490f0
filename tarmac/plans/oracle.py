"""DuckDB spellings of the stages, for the side-by-side correctness check.

Each builder returns a ``WITH`` prefix ending in a named CTE; the query
registry appends the final SELECT.  Output conventions shared with the Spark
side: integers as BIGINT, doubles rounded to 6 decimals, dates as DATE.
"""

from __future__ import annotations

from ..schemas import ALPHA, SPECS, WINDOWS, freq_col, rate_col
from ..sources.fixture import FIXTURE_SPLITS, FLIGHTS_SQL


def _hhmm(col: str) -> tuple[str, str]:
    """(minutes, hour) SQL for an HHMM column with floor div / floor mod."""
    h = f"floor({col} / 100.0)"
    m = f"({col} - 100 * floor({col} / 100.0))"
    minutes = f"CASE WHEN {m} < 60 THEN CAST({h} * 60 + {m} AS DOUBLE) END"
    hour = f"CAST(floor(({minutes}) / 60.0) AS INTEGER)"
    return minutes, hour


_DEP_MIN, _DEP_HOUR = _hhmm("CRS_DEP_TIME")
_ARR_MIN, _ARR_HOUR = _hhmm("CRS_ARR_TIME")

TYPED = FLIGHTS_SQL + f""",
typed AS (
 SELECT *, {_DEP_MIN} AS CRS_DEP_MINUTES, {_ARR_MIN} AS CRS_ARR_MINUTES,
  {_DEP_HOUR} AS CRS_DEP_HOUR, {_ARR_HOUR} AS CRS_ARR_HOUR
 FROM flights)"""

LABELED = TYPED + f""",
labeled AS (
 SELECT * REPLACE (year(flight_date) AS YEAR, month(flight_date) AS MONTH),
  CASE WHEN arr_delay_minutes >= 15.0 THEN 1 ELSE 0 END AS delayed_15
 FROM (SELECT *, COALESCE(FL_DATE, make_date(YEAR, MONTH, DAY_OF_MONTH)) AS flight_date,
              CASE WHEN isnan(ARR_DELAY) THEN NULL ELSE ARR_DELAY END AS arr_delay_minutes
       FROM typed)
 WHERE COALESCE(CANCELLED, 0) = 0 AND COALESCE(DIVERTED, 0) = 0 AND arr_delay_minutes IS NOT NULL)"""

_S = FIXTURE_SPLITS
SPLIT = LABELED + f""",
split_rows AS (
 SELECT * FROM (
  SELECT *, CASE WHEN flight_date <= DATE '{_S.train_end}' THEN 'train'
                 WHEN flight_date <= DATE '{_S.val_end}' THEN 'val'
                 WHEN flight_date <= DATE '{_S.test_end}' THEN 'test' END AS split
  FROM labeled) WHERE split IS NOT NULL)"""

DAYPART = """CASE WHEN {h} > -1 AND {h} <= 5 THEN 'night' WHEN {h} > 5 AND {h} <= 11 THEN 'morning'
  WHEN {h} > 11 AND {h} <= 17 THEN 'afternoon' WHEN {h} > 17 AND {h} <= 21 THEN 'evening'
  WHEN {h} > 21 AND {h} <= 23 THEN 'late' END"""

BASE = SPLIT + f""",
base AS (
 SELECT flight_date, year(flight_date) AS YEAR, month(flight_date) AS MONTH, DAY_OF_WEEK,
  CASE WHEN DAY_OF_WEEK IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
  week(flight_date) AS week_of_year, day(flight_date) AS day_of_month,
  OP_CARRIER, ORIGIN, DEST, ORIGIN || '-' || DEST AS route,
  {DAYPART.format(h='CRS_DEP_HOUR')} AS dep_daypart,
  DISTANCE, CRS_DEP_MINUTES, CRS_ARR_MINUTES, CRS_DEP_HOUR, CRS_ARR_HOUR, delayed_15, split
 FROM split_rows),
sbase AS (
 SELECT * REPLACE (COALESCE(OP_CARRIER, '__MISSING__') AS OP_CARRIER, COALESCE(ORIGIN, '__MISSING__') AS ORIGIN,
                   COALESCE(DEST, '__MISSING__') AS DEST, COALESCE(route, '__MISSING__') AS route,
                   COALESCE(CRS_DEP_HOUR, -1) AS CRS_DEP_HOUR)
 FROM base),
grate AS (SELECT avg(CAST(delayed_15 AS DOUBLE)) AS g FROM sbase)"""


def daily_cte(spec) -> str:
    """CTE ``daily_{spec}``: one row per (keys, flight_date) with n and s."""
    keys = ", ".join(spec.keys)
    return f"""daily_{spec.name} AS (
 SELECT {keys}, flight_date, COUNT(*) AS n, SUM(delayed_15) AS s FROM sbase GROUP BY {keys}, flight_date)"""


def rolling_cte(spec, windows=WINDOWS, alpha=ALPHA) -> str:
    """CTE ``roll_{spec}``: keys, flight_date, freq/rate per window (unrounded)."""
    keys = ", ".join(spec.keys)
    frames, cols = [], []
    for w in windows:
        frames.append(f"w{w} AS (PARTITION BY {keys} ORDER BY flight_date "
                      f"RANGE BETWEEN INTERVAL {w} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")
        cols.append(f"COALESCE(SUM(n) OVER w{w}, 0) AS n_{w}, COALESCE(SUM(s) OVER w{w}, 0) AS s_{w}")
    outs = []
    for w in windows:
        outs.append(f"CAST(n_{w} AS DOUBLE) AS {freq_col(spec.name, w)}")
        outs.append(f"(s_{w} + {alpha} * g) / (n_{w} + {alpha}) AS {rate_col(spec.name, w)}")
    return daily_cte(spec) + f""",
win_{spec.name} AS (
 SELECT {keys}, flight_date, {', '.join(cols)} FROM daily_{spec.name} WINDOW {', '.join(frames)}),
roll_{spec.name} AS (
 SELECT {keys}, flight_date, {', '.join(outs)} FROM win_{spec.name}, grate)"""


def with_aggs_cte(specs=SPECS, windows=WINDOWS) -> str:
    """CTE ``with_aggs``: sbase joined to every spec's rolling table."""
    parts = [rolling_cte(s, windows) for s in specs]
    joins = " ".join(
        f"LEFT JOIN roll_{s.name} USING ({', '.join(s.keys)}, flight_date)" for s in specs)
    return ",\n".join(parts) + f""",
with_aggs AS (SELECT * FROM sbase {joins})"""


def r6(expr: str, alias: str | None = None) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias or expr}"


def i64(expr: str, alias: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {alias or expr}"


# ---------------------------------------------------------------------------
# Store, requests and lookups
# ---------------------------------------------------------------------------

def store_cte(specs=SPECS, windows=WINDOWS) -> str:
    from ..schemas import aggregate_columns
    aggs = ", ".join(aggregate_columns(specs, windows))
    return with_aggs_cte(specs, windows) + f""",
store AS (SELECT flight_date, ORIGIN, DEST, OP_CARRIER, route, CRS_DEP_HOUR, {aggs}
          FROM with_aggs WHERE flight_date IS NOT NULL),
sstats AS (SELECT COALESCE(avg(origin_delay_rate_30d), 0.25) AS sg, max(flight_date) AS max_date FROM store)"""


def requests_cte(airports, carriers) -> str:
    """CTEs ``rq`` (raw requests), ``reqf`` (features + validity), ``rql`` (+ lookup date)."""
    ap = ", ".join(f"'{a}'" for a in airports)
    cr = ", ".join(f"'{c}'" for c in carriers)
    return f"""rq AS (
 SELECT CAST(o_orderkey AS VARCHAR) AS request_id,
  CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 121 AS INTEGER) AS DATE) AS flight_date,
  o_orderpriority AS carrier, na.n_name AS origin, nb.n_name AS dest,
  CAST(o_orderkey % 24 AS INTEGER) AS dep_hour, CAST(o_orderkey * 7 % 60 AS INTEGER) AS dep_minute,
  50 + na.n_nationkey * 97 + nb.n_nationkey * 31 AS distance
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation na ON c_nationkey = na.n_nationkey
  JOIN nation nb ON (c_nationkey * 7 + o_orderkey) % 25 = nb.n_nationkey),
reqf0 AS (
 SELECT request_id, flight_date, year(flight_date) AS YEAR, month(flight_date) AS MONTH,
  isodow(flight_date) AS DAY_OF_WEEK, CASE WHEN isodow(flight_date) IN (6, 7) THEN 1 ELSE 0 END AS is_weekend,
  week(flight_date) AS week_of_year, day(flight_date) AS day_of_month,
  upper(trim(carrier)) AS OP_CARRIER, upper(trim(origin)) AS ORIGIN, upper(trim(dest)) AS DEST,
  upper(trim(origin)) || '-' || upper(trim(dest)) AS route,
  CASE WHEN dep_hour <= 5 THEN 'night' WHEN dep_hour <= 11 THEN 'morning' WHEN dep_hour <= 17 THEN 'afternoon'
       WHEN dep_hour <= 21 THEN 'evening' ELSE 'late' END AS dep_daypart,
  CAST(distance AS DOUBLE) AS DISTANCE, dep_hour AS CRS_DEP_HOUR,
  CAST(dep_hour * 60 + dep_minute AS DOUBLE) AS CRS_DEP_MINUTES,
  CAST(NULL AS INTEGER) AS CRS_ARR_HOUR, CAST(NULL AS DOUBLE) AS CRS_ARR_MINUTES
 FROM rq),
reqf AS (
 SELECT *, invalid_reason IS NULL AS is_valid FROM (
  SELECT *, CASE WHEN ORIGIN = DEST THEN 'origin equals destination'
                 WHEN ORIGIN NOT IN ({ap}) THEN 'unsupported origin'
                 WHEN DEST NOT IN ({ap}) THEN 'unsupported destination'
                 WHEN OP_CARRIER NOT IN ({cr}) THEN 'unsupported carrier' END AS invalid_reason
  FROM reqf0)),
rql AS (SELECT reqf.*, least(flight_date, max_date) AS lookup_date, sg FROM reqf, sstats)"""


def lookup_own_sql(specs=SPECS, windows=WINDOWS, rounded: bool = True) -> tuple[str, str, str]:
    """(CTEs, FROM clause + select list of the 36 filled columns) for own-mode lookups."""
    from ..schemas import spec_columns
    ctes, joins, cols = [], [], []
    for i, s in enumerate(specs):
        sc = spec_columns(s, windows)
        ctes.append(f"lk_{s.name} AS (SELECT flight_date AS lookup_date, {', '.join(s.keys)}, "
                    + ", ".join(f"max({c}) AS {c}" for c in sc) + f" FROM store GROUP BY ALL)")
        cond = " AND ".join([f"l{i}.lookup_date = rql.lookup_date"] + [f"l{i}.{k} = rql.{k}" for k in s.keys])
        joins.append(f"LEFT JOIN lk_{s.name} l{i} ON {cond}")
        for c in sc:
            dflt = "0.0" if "_freq_" in c else "rql.sg"
            v = f"COALESCE(l{i}.{c}, {dflt})"
            cols.append(f"round({v}, 6) AS {c}" if rounded else f"{v} AS {c}")
    return ",\n".join(ctes), "FROM rql " + " ".join(joins), ", ".join(cols)


def lookup_overlay_sql(specs=SPECS, windows=WINDOWS) -> tuple[str, str, str]:
    from ..schemas import aggregate_columns
    aggs = aggregate_columns(specs, windows)
    order_all = ["ORIGIN", "DEST", "OP_CARRIER", "route", "CRS_DEP_HOUR"]
    ctes, joins = [], []
    for i, s in enumerate(specs):
        order = ", ".join(k for k in order_all if k not in s.keys)
        keys = ", ".join(s.keys)
        ctes.append(f"""ft_{s.name} AS (SELECT * FROM (
 SELECT flight_date AS lookup_date, {keys}, {', '.join(aggs)},
        row_number() OVER (PARTITION BY flight_date, {keys} ORDER BY {order}) AS rn FROM store) WHERE rn = 1)""")
        cond = " AND ".join([f"h{i}.lookup_date = rql.lookup_date"] + [f"h{i}.{k} = rql.{k}" for k in s.keys])
        joins.append(f"LEFT JOIN ft_{s.name} h{i} ON {cond}")
    cols = []
    for c in aggs:
        dflt = "0.0" if "_freq_" in c else "rql.sg"
        whens = " ".join(f"WHEN h{i}.lookup_date IS NOT NULL THEN h{i}.{c}" for i in reversed(range(len(specs))))
        cols.append(f"round(CASE {whens} ELSE {dflt} END, 6) AS {c}")
    return ",\n".join(ctes), "FROM rql " + " ".join(joins), ", ".join(cols)


def lookup_composite_sql(specs=SPECS, windows=WINDOWS) -> tuple[str, str, str]:
    from ..schemas import aggregate_columns
    aggs = aggregate_columns(specs, windows)
    keys = ["ORIGIN", "DEST", "OP_CARRIER", "route", "CRS_DEP_HOUR"]
    cte = (f"uq AS (SELECT flight_date AS lookup_date, {', '.join(keys)}, "
           + ", ".join(f"max({c}) AS {c}" for c in aggs) + " FROM store GROUP BY ALL)")
    cond = " AND ".join(["u.lookup_date = rql.lookup_date"] + [f"u.{k} = rql.{k}" for k in keys])
    cols = ", ".join(f"round(COALESCE(u.{c}, {'0.0' if '_freq_' in c else 'rql.sg'}), 6) AS {c}" for c in aggs)
    return cte, f"FROM rql LEFT JOIN uq u ON {cond}", cols
