"""Overlay lookups neither write nor shuffle rows with all aggregate columns."""

import os

from pyspark.sql import functions as F

from tarmac.operators import store as ST
from tarmac.plans import stages
from tarmac.schemas import SPECS, STORE_KEYS, aggregate_columns
from tarmac.session import shared_dir

from conftest import SF_SMALL


def _store(spark):
    d = F.to_date(F.lit("2024-01-01"))
    rows = [("B", "A", "x", "B_A", 5), ("A", "Z", "y", "A_Z", 9), ("A", "C", "y", "A_C", -1), ("A", "C", "x", "A_C", 7), ("A", "C", "x", "A_C", 7),
            (None, "C", "x", "N_C", 3), ("é", "C", "w", "é_C", 2)]
    df = spark.createDataFrame(rows, "ORIGIN string, DEST string, OP_CARRIER string, route string, CRS_DEP_HOUR smallint")
    return df.withColumn("flight_date", d).unionByName(df.withColumn("flight_date", F.date_add(d, 1)).where("DEST <> 'Z'")).select(*STORE_KEYS)


def test_first_keys_by_rank_are_those_by_struct(spark):
    store = _store(spark)
    got = ST.lookup_first_keys(store)
    for spec in SPECS:
        assert sorted(map(str, got[spec.name].collect())) == sorted(map(str, ST.lookup_first_key(store, spec).collect())), spec.name


def test_first_keys_take_one_hash_aggregate(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(ST, "materialize", lambda df, name, **k: plans.setdefault(name, df))
    ST.lookup_first_keys(_store(spark))
    plan = plans["first_keys"]._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Window" not in plan  # was one sort aggregate a spec


def test_overlay_by_daily_tables_equals_overlay_by_unique_rows(spark):
    tables = f"{shared_dir(spark)}/tables".removeprefix("file:")
    old = set(os.listdir(tables)) if os.path.isdir(tables) else set()
    lookups = stages.lookups(spark, SF_SMALL, "overlay")
    assert not [t for t in set(os.listdir(tables)) - old if t.startswith("unique-")]  # was written, 36 columns a row
    req, store, stats = stages.request_table(spark, SF_SMALL), stages.feature_store(spark, SF_SMALL), stages.store_stats(spark, SF_SMALL)
    cols = ["request_id", "lookup_date", *[F.round(c, 9).alias(c) for c in aggregate_columns()]]
    got = ST.enrich_requests(req, store, stats, mode="overlay", lookups=lookups).select(*cols)
    want = ST.enrich_requests(req, store, stats, mode="overlay").select(*cols)
    assert got.columns == want.columns and got.count() == want.count() > 0
    assert got.exceptAll(want).isEmpty()
