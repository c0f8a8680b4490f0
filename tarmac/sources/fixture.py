"""Flight rows derived from the TPC-H-style test tables.

The driver tables carry no airline data, so a deterministic view maps them
onto the on-time schema: ship date -> flight date, order priority ->
carrier, supplier / customer nation -> origin / destination, and arithmetic
rules over the keys for times, delay and flags.  The same view exists as a
DataFrame plan (for the engine) and as SQL text (for the DuckDB oracle).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ScopeConfig, SplitConfig
from ..session import ensure_parallelism, limit_methods

# Fixed parameters of the fixture.
FIXTURE_SPLITS = SplitConfig(dt.date(1999, 12, 31), dt.date(2000, 12, 31), dt.date(2001, 10, 31))
# A scope that keeps part of the fixture (nation names play airports).
def _nations(keys) -> tuple[str, ...]:
    return tuple(f"NATION_{k}" for k in keys)


FIXTURE_SCOPE = ScopeConfig(
    start=dt.date(1996, 1, 1),
    end=dt.date(2000, 12, 31),
    carriers=("1-URGENT", "2-HIGH", "3-MEDIUM"),
    origins=_nations(range(0, 12)),
    dests=_nations(range(0, 18)),
)
# Airports and carriers the request form accepts in the fixture world
# (nations 20-24 are "unsupported" so that invalid requests exist).
FIXTURE_SUPPORTED_AIRPORTS = _nations(range(0, 20))
FIXTURE_SUPPORTED_CARRIERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_methods(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed-stage flight rows (FIXTURES §3) as a DataFrame plan.

    ``lineitem x orders`` is the one large join (shuffled on the order key at
    scale).  Customers join the orders first, so that where they are too many to
    broadcast the orders are dealt by customer, not the line items; suppliers are left to the planner's
    size-based choice; ``nation`` has 25 rows by definition and is broadcast.
    """
    li = ensure_parallelism(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ns = F.broadcast(n.select(F.col("n_nationkey").alias("ns_key"), F.col("n_name").alias("ORIGIN")))
    nc = F.broadcast(n.select(F.col("n_nationkey").alias("nc_key"), F.col("n_name").alias("DEST")))

    o = o.join(c, o.o_custkey == c.c_custkey).join(nc, F.col("c_nationkey") == nc.nc_key)
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(s, F.col("l_suppkey") == s.s_suppkey)
         .join(ns, F.col("s_nationkey") == ns.ns_key))
    d = F.col("l_shipdate").cast("date")
    ok, pk = F.col("l_orderkey"), F.col("l_partkey")
    return j.select(
        F.year(d).alias("YEAR"),
        F.month(d).alias("MONTH"),
        F.dayofmonth(d).alias("DAY_OF_MONTH"),
        (F.weekday(d) + 1).alias("DAY_OF_WEEK"),
        F.col("o_orderpriority").alias("OP_CARRIER"),
        "ORIGIN",
        "DEST",
        ((pk % 25) * 100 + (ok % 64)).cast("int").alias("CRS_DEP_TIME"),
        (((pk + 3) % 25) * 100 + ((ok + 17) % 64)).cast("int").alias("CRS_ARR_TIME"),
        F.when(pk % 97 == 0, F.lit(None))
        .otherwise((ok * 7 + F.col("l_linenumber") * 13 + F.col("l_quantity").cast("int") * 5) % 80 - 72
                   # what a model can learn: carrier, origin and departure hour shift the delay
                   + F.length("o_orderpriority") % 4 * 8 + F.col("s_nationkey") % 5 * 6 + F.when(pk % 25 >= 16, 15).otherwise(0))
        .cast("double").alias("ARR_DELAY"),
        (F.lit(50) + F.col("s_nationkey") * 97 + F.col("c_nationkey") * 31).cast("double").alias("DISTANCE"),
        d.alias("FL_DATE"),
        F.when(ok % 53 == 0, F.lit(1)).when(ok % 11 == 0, F.lit(None)).otherwise(F.lit(0)).alias("CANCELLED"),
        F.when(ok % 101 == 0, F.lit(1)).otherwise(F.lit(0)).alias("DIVERTED"),
    )


# The same view as SQL text valid in DuckDB (and Spark SQL).
FLIGHTS_SQL = """
flights AS (
 SELECT year(CAST(l_shipdate AS DATE)) AS YEAR, month(CAST(l_shipdate AS DATE)) AS MONTH,
  day(CAST(l_shipdate AS DATE)) AS DAY_OF_MONTH, isodow(CAST(l_shipdate AS DATE)) AS DAY_OF_WEEK,
  o_orderpriority AS OP_CARRIER, ns.n_name AS ORIGIN, nc.n_name AS DEST,
  CAST((l_partkey % 25) * 100 + (l_orderkey % 64) AS INT) AS CRS_DEP_TIME,
  CAST(((l_partkey + 3) % 25) * 100 + ((l_orderkey + 17) % 64) AS INT) AS CRS_ARR_TIME,
  CAST(CASE WHEN l_partkey % 97 = 0 THEN NULL
       ELSE (l_orderkey * 7 + l_linenumber * 13 + CAST(l_quantity AS INT) * 5) % 80 - 72 + length(o_orderpriority) % 4 * 8
        + ns.n_nationkey % 5 * 6 + CASE WHEN l_partkey % 25 >= 16 THEN 15 ELSE 0 END END AS DOUBLE) AS ARR_DELAY,
  CAST(50 + ns.n_nationkey * 97 + nc.n_nationkey * 31 AS DOUBLE) AS DISTANCE,
  CAST(l_shipdate AS DATE) AS FL_DATE,
  CASE WHEN l_orderkey % 53 = 0 THEN 1 WHEN l_orderkey % 11 = 0 THEN NULL ELSE 0 END AS CANCELLED,
  CASE WHEN l_orderkey % 101 = 0 THEN 1 ELSE 0 END AS DIVERTED
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ns ON s_nationkey = ns.n_nationkey JOIN nation nc ON c_nationkey = nc.n_nationkey)
"""
