"""Rolling rates kept up day by day (A1, W1, D4): new days are added, nothing that is written is written again.

The state is a folder of batches, one an advance.  A batch holds the daily counts of its days for all key sets and their
trailing sums; a trailing sum needs the counts of the longest window before the first new day only, so an advance reads those
batches and the new flights.  Rates depend on the global rate, which moves with every day; so the sums are
stored, and the rates are made from them on reading.  A mark, written last, makes a batch part of the state: an
advance that fails leaves files that no reader takes up, and is run again.

The watermark is the last day of the state.  Flights up to it are late: they are refused (``ValueError``), or left out and counted with
``drop_late``.  Flights without a date are left out.
"""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ALPHA, SPECS, WINDOWS, AggSpec, freq_col, rate_col
from .rolling import daily_tables, sanitize_keys, smoothed_rate, trailing_sums

KEYS = ["_set", "_k0", "_k1"]
_MARK = "batch string, first date, upto date, flights long, delayed long, labelled long"
_DAYS = "_k0 string, _k1 string, flight_date date, n long, s long, labelled long, _set string"
#: Key columns that are not text.
KEY_TYPES = {"CRS_DEP_HOUR": "int"}


def marks(spark: SparkSession, root: str) -> list:
    """The batches of the state, a row each, by date."""
    found = spark.read.schema(_MARK).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    try:
        return found.json(f"{root}/marks").orderBy("upto").collect()
    except Exception as e:  # no advance yet
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


def watermark(spark: SparkSession, root: str) -> dt.date | None:
    """The last day of the state."""
    known = marks(spark, root)
    return known[-1]["upto"] if known else None


def _narrow(tables: dict[str, DataFrame], specs) -> DataFrame:
    """The daily tables of all key sets as one, keys as text."""
    parts = []
    for s in specs:
        keys = [F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(s.keys)]
        keys += [F.lit("").alias(f"_k{i}") for i in range(len(s.keys), 2)]
        parts.append(tables[s.name].select(F.lit(s.name).alias("_set"), *keys, "flight_date", "n", "s", "labelled"))
    return reduce(DataFrame.unionByName, parts)


def advance(spark: SparkSession, root: str, flights: DataFrame, specs=SPECS, windows=WINDOWS, drop_late: bool = False) -> dict:
    """Add the days after the watermark that ``flights`` holds; returns ``first``, ``upto``, ``flights`` and ``late``."""
    known = marks(spark, root)
    upto = known[-1]["upto"] if known else None
    dated = sanitize_keys(flights.where(F.col("flight_date").isNotNull()))
    fresh = dated if upto is None else dated.where(F.col("flight_date") > F.lit(upto))
    late = 0 if upto is None else dated.where(F.col("flight_date") <= F.lit(upto)).count()
    if late and not drop_late:
        raise ValueError(f"{late} flights up to {upto}, the watermark")
    batch = f"{root}/batches/{uuid.uuid4().hex[:12]}"
    _narrow(daily_tables(fresh, specs), specs).hint("rebalance", "_set").write.partitionBy("_set").parquet(f"{batch}/days")
    days = _read(spark, [batch], "days")
    span = days.where(F.col("_set") == specs[0].name).agg(
        F.min("flight_date").alias("first"), F.max("flight_date").alias("upto"), F.sum("n").alias("flights"),
        F.sum("s").alias("delayed"), F.sum("labelled").alias("labelled")).first()
    if span["first"] is None:
        return {"first": None, "upto": upto, "flights": 0, "late": late}
    since = span["first"] - dt.timedelta(days=max(windows))
    before = [m["batch"] for m in known if m["upto"] >= since]
    recent = days if not before else days.unionByName(_read(spark, before, "days").where(F.col("flight_date") >= F.lit(since)))
    sums = trailing_sums(recent, KEYS, windows).where(F.col("flight_date") >= F.lit(span["first"])).drop("n", "s", "labelled")
    sums.hint("rebalance", "_set").write.partitionBy("_set").parquet(f"{batch}/sums")
    mark = spark.createDataFrame([(batch, span["first"], span["upto"], span["flights"], span["delayed"], span["labelled"])], _MARK)
    mark.coalesce(1).write.json(f"{root}/marks/{batch.rpartition('/')[2]}")
    return {"first": span["first"], "upto": span["upto"], "flights": span["flights"], "late": late}


def _read(spark: SparkSession, batches: list[str], name: str) -> DataFrame:
    read = spark.read.schema(_DAYS) if name == "days" else spark.read  # an advance without flights has no file
    return reduce(DataFrame.unionByName, (read.parquet(f"{b}/{name}") for b in batches))


def rate_so_far(spark: SparkSession, root: str) -> Column:
    """The global rate over all days of the state, from the marks (A2)."""
    known = marks(spark, root)
    labelled = sum(m["labelled"] for m in known)
    return F.lit(sum(m["delayed"] or 0 for m in known) / labelled if labelled else None).cast("double")


def features(spark: SparkSession, root: str, spec: AggSpec, windows=WINDOWS, alpha: float = ALPHA) -> DataFrame:
    """One spec's daily feature table of the state: what :func:`.rolling.rolling_table` gives on all its flights."""
    sums = _read(spark, [m["batch"] for m in marks(spark, root)], "sums").where(F.col("_set") == spec.name)
    g = rate_so_far(spark, root)
    out = [F.col(f"_k{i}").cast(KEY_TYPES.get(k, "string")).alias(k) for i, k in enumerate(spec.keys)] + [F.col("flight_date")]
    for w in windows:
        out += [F.col(f"n_{w}d").cast("double").alias(freq_col(spec.name, w)),
                smoothed_rate(F.col(f"s_{w}d"), F.col(f"n_{w}d"), g, alpha).alias(rate_col(spec.name, w))]
    return sums.select(*out)
