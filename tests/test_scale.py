"""Steps whose cost must not grow with what they are repeated over."""
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarmac.functions import coerce as CO
from tarmac.operators import encoding as EN
from tarmac.operators import model as MD
from tarmac.plans import stages

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ordered_statistics_deal_the_rows_once_for_any_number_of_categories(spark):
    rows = [("a", "x", None, 1, 7 << 50), ("b", "x", "p", 0, 9 << 50), ("a", None, "p", 1, 3 << 50), ("a", "x", "p", None, 9 << 50)]
    df = spark.createDataFrame(rows, "c string, d string, e string, y int, o long")
    three = EN.ordered_target_statistics(df, ["c", "d", "e"], "y", F.col("o"))
    dealt = {n: _plan(EN.ordered_target_statistics(df, ["c", "d", "e"][:n], "y", F.col("o"))).count("Exchange") for n in (1, 3)}
    assert dealt[1] == dealt[3]
    assert "Join" not in _plan(three)
    for c in "cde":
        alone = EN.ordered_target_statistics(df, [c], "y", F.col("o"))
        assert sorted(alone.select(*"cdeo", f"{c}__ots").collect(), key=str) == sorted(three.select(*"cdeo", f"{c}__ots").collect(), key=str)


def test_shapley_paths_are_made_once_for_all_batches(monkeypatch):
    forest = {"w": np.ones(1), "pred": np.array([[0.0, 1.0, 3.0]]), "thr": np.array([[0.5, 0.0, 0.0]]), "feat": np.array([[1, -1, -1]]),
              "left": np.array([[1, -1, -1]]), "right": np.array([[2, -1, -1]]), "cover": np.array([[4.0, 1.0, 3.0]])}
    paths = MD.shapley_paths(forest)
    monkeypatch.setattr(MD, "leaf_paths", None)
    values, base = MD.shapley_values(np.array([[9.0, 0.0], [9.0, 1.0]]), forest, paths)
    assert base.tolist() == [2.5, 2.5] and values.tolist() == [[0.0, -1.5], [0.0, 0.5]]


def test_the_store_is_not_written_beside_the_join_back(spark):
    assert set(stages.feature_store(spark, SF_SMALL).inputFiles()) == set(stages.with_aggregates(spark, SF_SMALL).inputFiles())


def test_fixture_sessions_do_not_run_methods_that_are_never_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.unset(key)
    stages.flights(spark, SF_SMALL)
    assert spark.conf.get(key) == "8000"


@pytest.mark.parametrize("text", ["", " ", "a b", "\t a\x0b\n", "a  ", "a\x85", "  a", "a\xa0", "\r\n", None])
def test_strip_equals_the_pattern(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(CO.strip("t").alias("s"), F.regexp_replace("t", r"^\s+|\s+$", "").alias("r")).first()
    assert got.s == got.r


def test_dates_are_parsed_only_where_the_format_can_fit(spark):
    texts = ["2024-01-05", "1/6/2024 12:00:00 AM", "1/7/2024", " 1/8/2024 ", "1/9", "junk", "12:00:00", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r.d) if r.d else None for r in df.select(CO.to_date_lenient("t").alias("d")).collect()]
    assert got == ["2024-01-05", "2024-01-06", "2024-01-07", "2024-01-08", None, None, None, None]
    assert "contains" in _plan(df.select(CO.to_date_lenient("t"))).lower()


def test_the_join_back_is_not_written_while_its_tables_are_broadcast(spark, monkeypatch):
    """a reader joins the base rows; with a table over the bound the join-back is written, with the same rows."""
    lazy = stages.with_aggregates(spark, SF_SMALL)
    assert any("/base-" in f for f in lazy.inputFiles()) and not any("/with_aggs-" in f for f in lazy.inputFiles())
    want = sorted(map(str, lazy.collect()))
    monkeypatch.setattr(stages, "BROADCAST_MAX_BYTES", 0)
    written = stages.with_aggregates(spark, SF_SMALL)
    assert all("/with_aggs-" in f for f in written.inputFiles())
    assert sorted(map(str, written.select(lazy.columns).collect())) == want


def test_daily_tables_are_written_as_whole_sums(spark):
    """the rates are made on reading, so the tables keep within the broadcast bound."""
    tables, _ = stages.daily_stage(spark, SF_SMALL)
    root = tables["route"][0].inputFiles()[0].rpartition("/_t=")[0]
    types = {f.name: f.dataType.simpleString() for f in spark.read.parquet(root).schema if f.name.startswith("_v")}
    assert len(types) == 6 and set(types.values()) == {"bigint"}


def test_rates_are_rounded_by_day_not_by_flight(spark):
    """equal to rounding every flight's columns."""
    from tarmac.plans import queries as Q

    got = Q.REGISTRY["flights_with_aggs"][0](spark, SF_SMALL)
    top = _plan(got).split("Join")[0]
    assert "delay_rate" in top and not re.search(r"round\([^)]*(delay_rate|_freq_)", top)
    plain = Q.present(stages.with_aggregates(spark, SF_SMALL))
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())) and got.dtypes == plain.dtypes


def test_customers_join_orders_not_line_items(spark):
    """where customers are too many to broadcast, the line items are dealt once fewer."""
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(key, "-1")
    try:
        lines = _plan(stages.flights(spark, SF_SMALL)).splitlines()
        at = next(i for i, x in enumerate(lines) if "hashpartitioning(o_custkey" in x)
        depth = lines[at].index("Exchange")
        below = []
        for x in lines[at + 1:]:
            if len(x) - len(x.lstrip(" :+-")) <= depth:
                break
            below.append(x)
        assert below and not any("l_orderkey" in x for x in below)
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)


def test_a_sample_reads_its_rows_twice(spark, monkeypatch):
    """class sizes, then the lowest buckets, written; hot, rare and null classes keep their exact sizes."""
    from tarmac.operators import sampling as SM

    rows = [(0, i) for i in range(3000)] + [(1, 7)] * 2000 + [(2, 1), (2, 2)] + [(None, i) for i in range(500)]
    df = spark.createDataFrame(rows, "y int, v int")
    sizes, kept, real = {0: 3000, 1: 2000, 2: 2, None: 500}, [], SM.materialize
    monkeypatch.setattr(SM, "materialize", lambda t, name, **k: (kept.append(name), real(t, name, **k))[1])
    got = SM.capped_sample(df, 300, "y").collect()
    assert kept.count("sample_candidates") >= 1
    want = {k: SM._n1(n, 300, len(rows)) for k, n in sizes.items()}
    assert len(got) == min(300, sum(want.values()))
    assert len({r for r in got if r.y in (0, None)}) == sum(r.y in (0, None) for r in got)
    below = SM._candidates(df, spark.createDataFrame([(0, 3000, 30), (1, 2000, 20), (2, 2, 1), (None, 500, 5)], "y int, size long, n long"), "y", 42)[0]
    counts = {r.y: r["count"] for r in below.groupBy("y").count().collect()}
    assert 30 <= counts[0] < 300 and counts[1] == 2000 and counts[2] >= 1 and 5 <= counts[None] < 100


def test_rows_like_keeps_every_row_that_can_cancel(spark):
    from tarmac.operators import sampling as SM

    all_rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "c")], "k int, t string")
    few = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (4, "d")], "k int, t string")
    like = SM.rows_like(all_rows, few, ["k", "t"])
    assert sorted(map(str, few.exceptAll(like).collect())) == sorted(map(str, few.exceptAll(all_rows).collect()))
    assert like.count() == 3
