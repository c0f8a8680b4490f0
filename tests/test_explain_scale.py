"""Scoring and explaining a request costs little, whatever the size of the forest's paths."""

import numpy as np
from pyspark.sql import functions as F

from tarmac.operators import explain as X
from tarmac.operators import model as MD
from tarmac.plans import stages

from conftest import SF_SMALL


def _full_tree(depth, features, seed):
    rng, size = np.random.default_rng(seed), 2 ** (depth + 1) - 1
    f = {"w": np.ones(1), "pred": rng.normal(size=(1, size)), "thr": rng.normal(size=(1, size)), "feat": np.full((1, size), -1),
         "left": np.full((1, size), -1), "right": np.full((1, size), -1), "cover": np.zeros((1, size))}
    f["cover"][0, 0] = 1e6
    for i in range(2 ** depth - 1):
        f["left"][0, i], f["right"][0, i], f["feat"][0, i] = 2 * i + 1, 2 * i + 2, rng.integers(features)
        f["cover"][0, 2 * i + 1] = f["cover"][0, i] * rng.uniform(0.1, 0.9)
        f["cover"][0, 2 * i + 2] = f["cover"][0, i] - f["cover"][0, 2 * i + 1]
    return f


def _by_leaf(x, forest):
    """Shapley values leaf by leaf."""
    out = np.zeros(x.shape)
    for value, path in MD.leaf_paths(forest, 0).values():
        passed = np.array([[all((row[f] <= forest["thr"][0][n]) == go for n, go in zip(nodes, lefts)) for f, _, nodes, lefts in path] for row in x], float)
        for i, (f, *_) in enumerate(path):
            out[:, f] += value * MD.shapley_weights(passed, np.array([p[1] for p in path]))[:, i]
    return out


def test_blocks_give_what_the_leaves_give():
    for depth, features, seed in ((1, 2, 1), (4, 3, 2), (6, 40, 3), (8, 9, 4), (11, 60, 5)):
        forest = _full_tree(depth, features, seed)
        x = np.random.default_rng(seed).normal(size=(30, features))
        assert np.allclose(MD.shapley_values(x, forest)[0], _by_leaf(x, forest), rtol=0, atol=1e-12)


def test_a_row_takes_few_numbers_from_a_tree():
    forest = _full_tree(6, 50, 3)
    leaves = sum(len(path) for _, path in MD.leaf_paths(forest, 0).values())
    assert sum(len(tables) for *_, tables in MD.shapley_paths(forest)[0]) < leaves / 3  # was one a leaf and feature


def test_ranking_has_no_comparator_and_keeps_ties_in_order(spark):
    rows = [[("a", 0.5, 0), ("b", -0.5, 1), ("c", 0.5, 2), ("d", 0.0, 3), ("e", 2.0, 4), ("f", -3.0, 5), ("g", float("nan"), 6)], [], None]
    df = spark.createDataFrame([(r,) for r in rows], "c array<struct<feature:string,contribution:double,pos:int>>")
    out = df.select(X.ranked("c").alias("all"), X.ranked("c", 2, 1).alias("up"), X.ranked("c", 2, -1).alias("down"))
    assert "array_sort" not in out._jdf.queryExecution().optimizedPlan().toString()
    first, empty, none = out.collect()
    assert ["".join(d.feature for d in first[k]) for k in ("all", "up", "down")] == ["gfeabcd", "ge", "fb"]
    assert empty.asDict() == {"all": [], "up": [], "down": []} and none.asDict() == {"all": None, "up": None, "down": None}


def test_values_of_the_chosen_are_those_of_all(spark):
    cfg = MD.ModelConfig(feature_cols=["DISTANCE", "route", "CRS_DEP_HOUR"], cat_cols=["route"])
    df = spark.createDataFrame([(1.23456789, "A_B", None, [0.5, -0.2, 0.9]), (7.0, "__MISSING__", 5.0, [-1.0, 0.0, 0.1])],
                               "DISTANCE__raw double, route string, CRS_DEP_HOUR__raw double, contrib array<double>")
    lean, full = X.ranked(MD.contribution_structs(cfg, values=False)), X.ranked(MD.contribution_structs(cfg))
    got = df.select(MD.with_values(lean, *MD.raw_values(cfg)).alias("got"), full.alias("want"))
    assert got.schema["got"].dataType.simpleString() == got.schema["want"].dataType.simpleString()
    for r in got.collect():
        assert r.got == r.want


def test_store_statistics_join_the_spec_that_they_read(spark):
    one = stages.with_aggregates(spark, SF_SMALL, joined=stages.SPECS[:1])
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # was six
    from tarmac.operators import store as ST
    want = ST.stats_values(ST.store_stats(stages.feature_store(spark, SF_SMALL)))
    got = stages.store_stats(spark, SF_SMALL)
    assert got["max_date"] == want["max_date"] and abs(got["global_rate"] - want["global_rate"]) < 1e-12
