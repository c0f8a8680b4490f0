"""Leakage-safe trailing delay rates.

Plan shape, as Catalyst builds it:

    base --Expand(6 key sets)--> partial HashAggregate(set, K, d) --> Exchange --> final agg, written by set   (A1: one scan of the flights)
    days of a set --> Exchange(K) --> Sort(K, day) --> Window(all 3 windows x n, s) (W1, one Window node)
         --> Project(smoothing)                                          (A3)

The window never sees raw flights: after A1 a key holds at most one row per
calendar day, so even a key with a third of all flights is a few thousand
rows.  The trailing sum covers the days [d-w, d-1] (the current day is
excluded); it is computed as a difference of two running totals over the
day number (see :func:`trailing_sums`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import sanitize_hour, sanitize_key
from ..schemas import ALPHA, LABEL, SPECS, WINDOWS, AggSpec, freq_col, rate_col, spec_columns
from ..session import materialize, materialize_family

STRING_KEYS = ("OP_CARRIER", "ORIGIN", "DEST", "route")
# Daily feature tables of at most this stored size are broadcast to the join-back.
BROADCAST_MAX_BYTES = 32 << 20


def sanitize_keys(df: DataFrame) -> DataFrame:
    """String keys null -> ``__MISSING__`` and stripped; hour null -> -1."""
    cols = {c: sanitize_key(c) for c in STRING_KEYS if c in df.columns}
    if "CRS_DEP_HOUR" in df.columns:
        cols["CRS_DEP_HOUR"] = sanitize_hour("CRS_DEP_HOUR")
    return df.withColumns(cols)


def global_rate(rows: DataFrame, scope: str = "all") -> Column:
    """Mean label as a literal Column.

    ``rows`` are flights, or the daily counts of one key set (``scope="all"``).  ``scope="all"`` averages every split (the
    reference's behaviour, D11); ``"train"`` averages the train split only (leak-free).  One aggregate job
    yields one number, which is inlined into every expression that uses it
    (a scalar subquery would be re-planned at each of its 18+ uses).
    """
    src = rows.where(F.col("split") == "train") if scope == "train" else rows
    if "labelled" in src.columns:
        delayed, labelled = src.agg(F.sum("s"), F.sum("labelled")).first()
    else:
        delayed, labelled = src.agg(F.sum(F.col(LABEL).cast("long")), F.count(LABEL)).first()
    return F.lit(delayed / labelled if labelled else None).cast("double")


def smoothed_rate(s: Column, n: Column, g: Column, alpha: float = ALPHA) -> Column:
    """Empirical-Bayes rate ``(s + alpha*g) / (n + alpha)`` in double (A3)."""
    return (s.cast("double") + F.lit(alpha) * g) / (n.cast("double") + F.lit(alpha))


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col(LABEL).cast("long")).alias("s"), F.count(LABEL).alias("labelled")]


def daily_counts(rows: DataFrame, keys) -> DataFrame:
    """One row per (keys, flight_date): ``n`` flights, ``s`` delayed, ``labelled`` (A1)."""
    return rows.groupBy(*keys, "flight_date").agg(*_counts())


def set_numbers(specs, cols) -> dict[str, int]:
    """The ``grouping_id`` of every spec's set in ``groupingSets(sets, *cols, "flight_date")``."""
    # A bit of grouping_id is 1 where the column is not of the set; the day is of all sets and the last bit.
    return {s.name: sum(2 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s.keys) for s in specs}


def daily_tables(base: DataFrame, specs=SPECS, materialize_table: bool = True) -> dict[str, DataFrame]:
    """The daily counts of every spec by one GROUPING SETS aggregate over (key set, day).

    The flights are scanned once.  Each task keeps a partial row per key set, key and day, so what is
    shuffled is bounded by keys x days of a task, not by its flights.  The result is written with the number of its
    key set as partition, and each spec reads its own part.
    """
    cols = list(dict.fromkeys(k for s in specs for k in s.keys))
    sets = [[*(F.col(k) for k in s.keys), F.col("flight_date")] for s in specs]
    grouped = base.groupingSets(sets, *cols, "flight_date").agg(*_counts(), F.grouping_id().alias("_set"))
    if materialize_table:
        grouped = materialize(grouped, "days", partition_by="_set")
    number = set_numbers(specs, cols)
    return {s.name: grouped.where(F.col("_set") == number[s.name]).select(*s.keys, "flight_date", "n", "s", "labelled") for s in specs}


def trailing_sums(daily: DataFrame, keys, windows=WINDOWS) -> DataFrame:
    """Left-closed trailing sums of n and s over days [d-w, d-1] for every window.

    A sliding ``RANGE BETWEEN w PRECEDING AND 1 PRECEDING`` sum is
    re-aggregated by Spark each time the frame's lower bound moves
    (O(rows x w)).  The same integer sum is a difference of two running
    totals, ``S(<= d-1) - S(<= d-w-1)``, and frames that start at
    UNBOUNDED PRECEDING are evaluated incrementally (O(rows)).  All frames
    share one partition/order spec, so they run in one Window operator.
    """
    day = F.unix_date(F.col("flight_date"))
    spec = Window.partitionBy(*keys).orderBy(day)

    def upto(col: str, lag: int):
        return F.coalesce(F.sum(col).over(spec.rangeBetween(Window.unboundedPreceding, -lag)), F.lit(0))

    cols = {}
    for w in windows:
        cols[f"n_{w}d"] = (upto("n", 1) - upto("n", w + 1)).cast("long")
        cols[f"s_{w}d"] = (upto("s", 1) - upto("s", w + 1)).cast("long")
    return daily.withColumns(cols)


def rolling_sums_for_spec(rows: DataFrame, spec: AggSpec, windows=WINDOWS) -> DataFrame:
    """Trailing sums of one spec: keys, flight_date, then ``n_{w}d`` and ``s_{w}d`` of every window; ``rows`` as below."""
    keys = list(spec.keys)
    rolled = trailing_sums(rows if "labelled" in rows.columns else daily_counts(rows, keys), keys, windows)
    return rolled.select(*keys, "flight_date", *[f"{c}_{w}d" for w in windows for c in "ns"])


def rates_of_sums(sums: DataFrame, spec: AggSpec, g: Column, windows=WINDOWS, alpha: float = ALPHA) -> DataFrame:
    """The daily feature table of trailing sums."""
    out = [*spec.keys, "flight_date"]
    for w in windows:
        n, s = F.col(f"n_{w}d"), F.col(f"s_{w}d")
        out += [n.cast("double").alias(freq_col(spec.name, w)),
                smoothed_rate(s, n, g, alpha).alias(rate_col(spec.name, w))]
    return sums.select(*out)


def rolling_features_for_spec(rows: DataFrame, spec: AggSpec, g: Column,
                              windows=WINDOWS, alpha: float = ALPHA) -> DataFrame:
    """Daily feature table of one spec: keys, flight_date, then per window
    ``{spec}_freq_{w}d`` and ``{spec}_delay_rate_{w}d`` (W2).

    ``rows`` are flights or the spec's daily counts.  Values stay attached to their own (keys, date) row (D1).
    """
    return rates_of_sums(rolling_sums_for_spec(rows, spec, windows), spec, g, windows, alpha)


def join_rolling(df: DataFrame, feats: DataFrame, spec: AggSpec, g: Column,
                 windows=WINDOWS) -> DataFrame:
    """Left join of one spec's daily features on (keys, flight_date), then fill.

    The right side is unique on the join key, so the row count is kept.
    """
    out = df.join(feats, [*spec.keys, "flight_date"], "left")
    fill = {}
    for w in windows:
        fill[freq_col(spec.name, w)] = F.coalesce(F.col(freq_col(spec.name, w)), F.lit(0.0))
        fill[rate_col(spec.name, w)] = F.coalesce(F.col(rate_col(spec.name, w)), g)
    return out.withColumns(fill)


def daily_features(base: DataFrame, specs=SPECS, windows=WINDOWS, alpha: float = ALPHA, rate_scope: str = "all",
                   materialize_tables: bool = True) -> tuple[dict[str, tuple[DataFrame, int]], Column]:
    """The daily feature table of every spec with its stored size, and the global rate.

    Written, these tables are also the own-mode lookup tables: a (date, keys) of the store has the values of this table.
    """
    base = sanitize_keys(base)
    days = daily_tables(base, specs, materialize_tables)
    g = global_rate(base, rate_scope) if rate_scope == "train" else global_rate(days[specs[0].name])
    sums = {spec.name: (rolling_sums_for_spec(days[spec.name], spec, windows), 0) for spec in specs}
    if materialize_tables:
        # The whole sums are written, which take a third of the room of the rates made from them on reading.
        sums = materialize_family({k: t for k, (t, _) in sums.items()}, {s.name: [*s.keys, "flight_date"] for s in specs}, "daily")
    return {s.name: (rates_of_sums(sums[s.name][0], s, g, windows, alpha), sums[s.name][1]) for s in specs}, g


def rounded_features(tables, decimals: int) -> tuple[dict[str, tuple[DataFrame, int]], Column]:
    """Daily feature tables and global rate of :func:`daily_features`, rounded: once a (keys, day), not once a flight."""
    feats, g = tables
    value = lambda t: {c: F.round(c, decimals) for c in t.columns if "_freq_" in c or "_delay_rate_" in c}
    return {name: (t.withColumns(value(t)), n) for name, (t, n) in feats.items()}, F.round(g, decimals)


def add_rolling_features(base: DataFrame, specs=SPECS, windows=WINDOWS, alpha: float = ALPHA,
                         rate_scope: str = "all", materialize_tables: bool = True,
                         broadcast_max_bytes: int = BROADCAST_MAX_BYTES, tables=None) -> DataFrame:
    """Base rows (all splits) -> base rows + 6 x 3 x 2 aggregate columns.

    With ``materialize_tables`` the daily counts are written first (one scan of the flights), then
    the six daily feature tables in one job; ``tables`` takes both from :func:`daily_features`.  A table is broadcast only
    when its stored size is within ``broadcast_max_bytes``; larger ones join by shuffle (sort-merge, AQE skew splitting).
    """
    feats, g = tables or daily_features(base, specs, windows, alpha, rate_scope, materialize_tables)
    out = base = sanitize_keys(base)
    order = list(specs)
    if materialize_tables:
        small = {name for name, (_, n) in feats.items() if n <= broadcast_max_bytes}
        feats = {name: (F.broadcast(t) if name in small else t, n) for name, (t, n) in feats.items()}
        # Tables over the bound join by shuffling the fact rows: do those first,
        # while the rows still carry few feature columns; broadcasts follow.
        order = [s for s in specs if s.name not in small] + [s for s in specs if s.name in small]
    for spec in order:
        out = join_rolling(out, feats[spec.name][0], spec, g, windows)
    return out.select(*base.columns, *[c for s in specs for c in spec_columns(s, windows)])


def rolling_table(base: DataFrame, spec: AggSpec, windows=WINDOWS, alpha: float = ALPHA,
                  rate_scope: str = "all") -> DataFrame:
    """Convenience: base -> one spec's daily feature table.  The flights are read once, by the spec's own keys."""
    rows = sanitize_keys(base)
    days = materialize(daily_counts(rows, list(spec.keys)), "days")
    g = global_rate(rows, rate_scope) if rate_scope == "train" else global_rate(days)
    return rolling_features_for_spec(days, spec, g, windows, alpha)


def daily_table(base: DataFrame, spec: AggSpec) -> DataFrame:
    """Convenience: base -> one spec's (keys, date, n, s) table."""
    return daily_counts(sanitize_keys(base), list(spec.keys)).drop("labelled")
