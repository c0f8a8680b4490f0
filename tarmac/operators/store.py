"""Feature store, lookup tables and batch request enrichment.

The reference answers one request at a time from in-memory hash maps.  Here
the maps are DataFrames unique on ``(date, keys)`` and a whole table of
requests is enriched with left joins; each lookup table is bounded by
(#keys x #days), written to the shared folder and broadcast only when its
stored size is within a checked bound.

Modes (D2):

* ``own`` (default): every lookup fills only its own spec's columns, which
  are constant per (keys, date), so the result is deterministic.
* ``overlay``: the reference's sequence of overlays where each hit replaces
  all aggregate columns; the last spec with a hit wins.  "First" row per
  (date, keys) is defined by a total order over the other store keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_STORE_RATE, SPECS, STORE_KEYS, WINDOWS, aggregate_columns, spec_columns
from ..session import materialize, materialize_family, stored_bytes
from .rolling import sanitize_keys, set_numbers

LOOKUP_BROADCAST_MAX_BYTES = 32 << 20


def _is_freq(c: str) -> bool:
    return "_freq_" in c


def build_store(with_aggs: DataFrame, agg_cols=None) -> DataFrame:
    """One row per flight: the six lookup keys + all aggregate columns."""
    agg_cols = list(aggregate_columns() if agg_cols is None else agg_cols)
    keys = [k for k in STORE_KEYS if k in with_aggs.columns]
    out = with_aggs.where(F.col("flight_date").isNotNull()).select(*keys, *agg_cols)
    return sanitize_keys(out)


def store_stats(store: DataFrame, agg_cols=None) -> DataFrame:
    """One-row stats: ``global_rate`` = mean of the first rate column (else 0.25), ``max_date`` (A4, A5)."""
    agg_cols = list(agg_cols or aggregate_columns())
    rates = [c for c in agg_cols if "_delay_rate_" in c]
    g = F.avg(F.col(rates[0])) if rates else F.lit(None).cast("double")
    return store.agg(F.coalesce(g, F.lit(DEFAULT_STORE_RATE)).alias("global_rate"),
                     F.max("flight_date").alias("max_date"))


def _fill_defaults(cols, g: Column) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit(0.0) if _is_freq(c) else g) for c in cols}


def lookup_table_own(store: DataFrame, spec, windows=WINDOWS) -> DataFrame:
    """(date, keys) -> this spec's columns.  Values are constant per key, so
    ``max`` is a deterministic pick and combines map-side for hot keys (V2)."""
    cols = spec_columns(spec, windows)
    return store.groupBy("flight_date", *spec.keys).agg(*[F.max(c).alias(c) for c in cols])


def lookup_table_first(store: DataFrame, spec, agg_cols=None) -> DataFrame:
    """(date, keys) -> all aggregate columns of the first store row.

    "First" = smallest (ORIGIN, DEST, OP_CARRIER, route, CRS_DEP_HOUR); rows
    equal on those share every aggregate value.  ``min(struct)`` is a plain
    partial aggregate: no window, no task ever holds a whole hot group.
    """
    agg_cols = list(agg_cols or aggregate_columns())
    order = [k for k in STORE_KEYS if k != "flight_date" and k not in spec.keys]
    first = F.min(F.struct(*[F.col(k) for k in order], *[F.col(c) for c in agg_cols])).alias("first")
    return store.groupBy("flight_date", *spec.keys).agg(first).select(
        "flight_date", *spec.keys, *[F.col(f"first.{c}").alias(c) for c in agg_cols])


def stats_values(stats) -> dict:
    """The one-row stats as two Python values (one tiny job), or the dict given."""
    if isinstance(stats, dict):
        return stats
    row = stats.first()
    return {"global_rate": float(row["global_rate"]), "max_date": row["max_date"]}


def stat(stats, name: str) -> Column:
    """A store statistic as a literal Column (computed once, inlined everywhere)."""
    return F.lit(stats_values(stats)[name])


def lookup_first_key(store: DataFrame, spec) -> DataFrame:
    """(date, keys) -> ``full``: the full store key of the first row (W4, R2, overlay).

    "First" = smallest (ORIGIN, DEST, OP_CARRIER, route, CRS_DEP_HOUR).  Only
    the key struct is aggregated (``min`` combines map-side); values are
    fetched later by one join on the full key.
    """
    full_keys = [k for k in STORE_KEYS if k != "flight_date"]
    order = [k for k in full_keys if k not in spec.keys]
    first = store.groupBy("flight_date", *spec.keys).agg(F.min(F.struct(*order)).alias("_o"))
    full = F.struct(*[(F.col(k) if k in spec.keys else F.col(f"_o.{k}")).alias(k) for k in full_keys])
    return first.select("flight_date", *spec.keys, full.alias("full"))


def ranked_keys(store: DataFrame) -> DataFrame:
    """The distinct full store keys but the date, with a ``_rank`` that grows in key order; written.

    There are as many as flown combinations of the five keys, whatever the number of days and flights.
    """
    full_keys = [k for k in STORE_KEYS if k != "flight_date"]
    return materialize(store.select(*full_keys).distinct().orderBy(*full_keys).withColumn("_rank", F.monotonically_increasing_id()), "full_keys")


def lookup_first_keys(store: DataFrame, specs=SPECS) -> dict[str, DataFrame]:
    """:func:`lookup_first_key` of every spec, by one aggregate.

    Rows of a group agree on the spec's keys, so their order by the other keys is the order of their full keys: the first row has the least
    rank.  A rank is a long, so groups combine in hash maps; only (date, spec keys, rank) is shuffled.
    """
    full_keys = [k for k in STORE_KEYS if k != "flight_date"]
    ranks = ranked_keys(store)
    named = ranks.withColumnsRenamed({k: f"_r_{k}" for k in full_keys})
    rows = store.select("flight_date", *full_keys).join(named, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in full_keys])
    cols = list(dict.fromkeys(k for s in specs for k in s.keys))
    sets = [[*(F.col(k) for k in s.keys), F.col("flight_date")] for s in specs]
    firsts = rows.groupingSets(sets, *cols, "flight_date").agg(F.min("_rank").alias("_first"), F.grouping_id().alias("_set"))
    firsts, number = materialize(firsts, "first_keys", partition_by="_set"), set_numbers(specs, cols)
    full = ranks.select("_rank", F.struct(*full_keys).alias("full"))
    return {s.name: firsts.where(F.col("_set") == number[s.name]).join(full, F.col("_first") == F.col("_rank"))
            .select("flight_date", *s.keys, "full") for s in specs}


def unique_rows(store: DataFrame, agg_cols=None) -> DataFrame:
    """One row per (date, all five keys) with its values; rows equal on the keys
    carry equal values, so ``max`` is a deterministic pick (hash aggregate)."""
    agg_cols = list(agg_cols or aggregate_columns())
    keys = [k for k in STORE_KEYS if k != "flight_date"]
    return store.groupBy("flight_date", *keys).agg(*[F.max(c).alias(c) for c in agg_cols])


def lookup_date(stats) -> Column:
    """``least(requested, max_date)``: not an as-of search, a clamp."""
    return F.least(F.col("flight_date"), stat(stats, "max_date"))


def _unique_lookup(store: DataFrame, agg_cols) -> DataFrame:
    """The unique-per-key table, not written: it is one hash aggregate over the
    (already written) store and about as large as it, so it is never a broadcast side by hint."""
    return unique_rows(store, agg_cols).withColumnRenamed("flight_date", "lookup_date")


def _prepare_lookups(tables: dict, specs, materialize_tables: bool, max_bytes: int) -> dict:
    """All six lookup tables written in one job; each broadcast only within ``max_bytes`` stored."""
    tables = {k: t.withColumnRenamed("flight_date", "lookup_date") for k, t in tables.items()}
    if not materialize_tables:
        return tables
    keys = {s.name: ["lookup_date", *s.keys] for s in specs}
    written = materialize_family(tables, keys, "lookups")
    return {k: (F.broadcast(t) if n <= max_bytes else t) for k, (t, n) in written.items()}


def lookups_from_daily(tables: dict, broadcast_max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES) -> dict:
    """Own-mode lookups from the written daily feature tables (:func:`.rolling.daily_features`): nothing is aggregated (V2).

    Every (date, keys) of the store has its values there; rows without a date are never looked up.
    """
    out = {}
    for name, (t, n) in tables.items():
        t = t.where(F.col("flight_date").isNotNull()).withColumnRenamed("flight_date", "lookup_date")
        out[name] = F.broadcast(t) if n <= broadcast_max_bytes else t
    return out


def build_lookups(store: DataFrame, mode: str = "own", specs=SPECS, windows=WINDOWS,
                  materialize_tables: bool = True, broadcast_max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES, daily: dict | None = None) -> dict:
    """The lookup tables of one store snapshot (V2), built once and reused by every enrichment.

    ``own``: one (date, keys) -> spec-columns table per spec.  ``overlay``: one
    (date, keys) -> first-row-key table per spec plus the unique-row table.  Where ``daily`` has the written daily feature tables that the
    store was joined from (:func:`.rolling.daily_features`), a row's values are in these by its keys, and ``store`` needs no columns but its keys.
    """
    agg_cols = aggregate_columns(specs, windows)
    if mode == "own":
        return _prepare_lookups({s.name: lookup_table_own(store, s, windows) for s in specs}, specs,
                                materialize_tables, broadcast_max_bytes)
    if mode == "overlay" and daily is not None:
        out = _prepare_lookups(lookup_first_keys(store, specs), specs, materialize_tables, broadcast_max_bytes)
        return out | {"_daily": lookups_from_daily(daily, broadcast_max_bytes)}
    if mode == "overlay":
        # The store is collapsed to its distinct keys once; the first-key tables read the narrow result.
        uniq = materialize(unique_rows(store, agg_cols), "unique") if materialize_tables else unique_rows(store, agg_cols)
        out = _prepare_lookups({s.name: lookup_first_key(uniq, s) for s in specs}, specs,
                               materialize_tables, broadcast_max_bytes)
        out["_unique"] = uniq.withColumnRenamed("flight_date", "lookup_date")
        return out
    raise ValueError(f"unknown lookup mode {mode!r}")


def enrich_requests(req: DataFrame, store: DataFrame, stats=None, mode: str = "own",
                    specs=SPECS, windows=WINDOWS, materialize_tables: bool = True,
                    broadcast_max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES, lookups: dict | None = None) -> DataFrame:
    """Request features -> + ``lookup_date`` + every aggregate column.

    One job for any number of requests; defaults are freq 0 and the store's
    global rate when a lookup misses.
    """
    stats = stats_values(stats if stats is not None else store_stats(store))
    agg_cols = aggregate_columns(specs, windows)
    g = stat(stats, "global_rate")
    out = sanitize_keys(req).withColumn("lookup_date", lookup_date(stats))
    tables = lookups if lookups is not None else build_lookups(store, mode, specs, windows, materialize_tables,
                                                               broadcast_max_bytes)
    if mode == "own":
        for spec in specs:
            out = out.join(tables[spec.name], ["lookup_date", *spec.keys], "left")
        return out.withColumns(_fill_defaults(agg_cols, g))
    if mode == "overlay":
        # Per spec only the first row's full key (a 5-field struct) is looked up;
        # the last spec with a hit names one store row, whose 36 values come
        # from a single join with the store's unique-per-key table, or from the daily tables by that row's keys.
        full_keys = [k for k in STORE_KEYS if k != "flight_date"]
        for spec in specs:
            out = out.join(tables[spec.name].withColumnRenamed("full", f"full_{spec.name}"),
                           ["lookup_date", *spec.keys], "left")
        winner = F.coalesce(*[F.col(f"full_{s.name}") for s in reversed(specs)])
        out = out.withColumn("_win", winner).drop(*[f"full_{s.name}" for s in specs])
        if "_daily" in tables:
            for spec in specs:
                day = tables["_daily"][spec.name].withColumnsRenamed({k: f"_w_{k}" for k in ("lookup_date", *spec.keys)})
                cond = [F.col("lookup_date") == F.col("_w_lookup_date"), *[F.col(f"_win.{k}") == F.col(f"_w_{k}") for k in spec.keys]]
                out = out.join(day, cond, "left").drop(*[f"_w_{k}" for k in ("lookup_date", *spec.keys)])
            return out.drop("_win").withColumns(_fill_defaults(agg_cols, g))
        uniq = tables["_unique"].select(*[F.col(k).alias(f"_w_{k}") for k in ["lookup_date", *full_keys]], *agg_cols)
        cond = [F.col("lookup_date") == F.col("_w_lookup_date")] + \
               [F.col(f"_win.{k}") == F.col(f"_w_{k}") for k in full_keys]
        out = out.join(uniq, cond, "left").drop("_win", *[f"_w_{k}" for k in ["lookup_date", *full_keys]])
        return out.withColumns(_fill_defaults(agg_cols, g))
    raise ValueError(f"unknown lookup mode {mode!r}")


def lookup_composite(req: DataFrame, store: DataFrame, stats: DataFrame | None = None, agg_cols=None) -> DataFrame:
    """Exact lookup on all six store keys at the clamped date, default fill.

    The store is collapsed to one row per key combination first (rows equal
    on the keys carry equal values), so the join keeps the request count.
    """
    stats = stats_values(stats if stats is not None else store_stats(store))
    agg_cols = list(agg_cols or aggregate_columns())
    g = stat(stats, "global_rate")
    keys = [k for k in STORE_KEYS if k != "flight_date"]
    out = sanitize_keys(req).withColumn("lookup_date", lookup_date(stats))
    # Only the store rows that a request names are aggregated; the requests are the small side.
    asked = out.select(F.col("lookup_date").alias("flight_date"), *keys).distinct()
    uniq = _unique_lookup(store.join(asked, ["flight_date", *keys], "left_semi"), agg_cols)
    out = out.join(uniq, ["lookup_date", *keys], "left")
    return out.withColumns(_fill_defaults(agg_cols, g))


def load_store(spark, path: str, agg_cols=None, stats_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature-store handle: the store rows (null dates dropped) + one-row stats (V3, A4, A5).

    With ``stats_path`` the stats are the ones that :func:`tarmac.plans.pipeline.build_lookup_tables` wrote.
    """
    store = spark.read.parquet(path).where(F.col("flight_date").isNotNull())
    return store, spark.read.parquet(stats_path) if stats_path else store_stats(store, agg_cols)


def load_lookups(spark, root: str, specs=SPECS, mode: str = "own", store: DataFrame | None = None,
                 broadcast_max_bytes: int = LOOKUP_BROADCAST_MAX_BYTES) -> dict:
    """Read persisted lookup tables (``{root}/by_{spec}``) for enrichment (V2 -> V4).

    Overlay tables name a store row, so that mode needs the ``store`` too.  A table is broadcast only
    within ``broadcast_max_bytes`` stored.
    """
    out = {}
    for spec in specs:
        t = spark.read.parquet(f"{root}/by_{spec.name}").withColumnRenamed("flight_date", "lookup_date")
        size = stored_bytes(spark, f"{root}/by_{spec.name}").agg(F.sum("length")).first()[0] or 0
        out[spec.name] = F.broadcast(t) if size <= broadcast_max_bytes else t
    if mode == "overlay":
        out["_unique"] = _unique_lookup(store, aggregate_columns(specs))
    return out
