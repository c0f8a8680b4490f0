"""Shapley values, ordered target statistics and header prefixes against plain versions."""

import io
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.operators import encoding as EN
from tarmac.operators import model as MD
from tarmac.sources import csv as C


def random_forest(rng, trees, depth, features):
    """Full trees with random splits; some leaves stay shallow."""
    size = 2 ** (depth + 1) - 1
    forest = {k: np.zeros((trees, size)) for k in ("pred", "thr", "cover")} | {
        k: np.full((trees, size), -1) for k in ("left", "right", "feat")} | {"w": rng.uniform(0.1, 1, trees)}
    for t in range(trees):
        todo = [(0, 0)]
        forest["cover"][t, 0] = 1000
        while todo:
            node, level = todo.pop()
            forest["pred"][t, node] = rng.normal()
            if level == depth or (level and rng.random() < 0.2):
                continue
            left, right, share = 2 * node + 1, 2 * node + 2, rng.uniform(0.05, 0.95)
            forest["left"][t, node], forest["right"][t, node] = left, right
            forest["feat"][t, node], forest["thr"][t, node] = rng.integers(features), rng.normal()
            forest["cover"][t, left], forest["cover"][t, right] = forest["cover"][t, node] * share, forest["cover"][t, node] * (1 - share)
            todo += [(left, level + 1), (right, level + 1)]
    return forest


def game(x, known, forest, t, node=0):
    """Value of a tree with the features of ``known``, by recursion."""
    left, right = forest["left"][t, node], forest["right"][t, node]
    if left < 0:
        return forest["pred"][t, node]
    f = forest["feat"][t, node]
    if f in known:
        return game(x, known, forest, t, left if x[f] <= forest["thr"][t, node] else right)
    share = forest["cover"][t, left] / forest["cover"][t, node]
    return share * game(x, known, forest, t, left) + (1 - share) * game(x, known, forest, t, right)


@pytest.mark.parametrize("depth", [0, 1, 3, 5])
def test_shapley_values_equal_enumeration_of_all_sets(depth):
    rng, features = np.random.default_rng(depth), 5
    forest, x = random_forest(rng, 4, depth, features), rng.normal(size=(12, features))
    x[3] = x[2]
    got, base = MD.shapley_values(x, forest)
    value = lambda row, known: sum(w * game(row, known, forest, t) for t, w in enumerate(forest["w"]))
    for row, phi, b in zip(x, got, base):
        assert abs(b - value(row, ())) < 1e-9 and abs(b + phi.sum() - value(row, range(features))) < 1e-9
        for i in range(features):
            rest, want = [j for j in range(features) if j != i], 0.0
            for s in range(features):
                share = math.factorial(s) * math.factorial(features - s - 1) / math.factorial(features)
                want += share * sum(value(row, {*k, i}) - value(row, k) for k in itertools.combinations(rest, s))
            assert abs(phi[i] - want) < 1e-9
    empty, none = MD.shapley_values(np.zeros((0, features)), forest)
    assert empty.shape == (0, features) and len(none) == 0


def test_both_attributions_add_up_on_a_fitted_forest(spark, with_aggs):
    from tarmac.plans import modeling as MO

    cfg = MD.ModelConfig(max_iter=4, patience=4, max_depth=4, max_bins=32)
    model = MO.train(with_aggs, cfg)
    scored = MD.score(model, with_aggs.where("split = 'test'"), cfg).select("features", "margin")
    for method in MD.ATTRIBUTIONS:
        total = F.aggregate("contrib", F.lit(0.0), lambda a, b: a + b)
        off = MD.add_contributions(scored, model, cfg, method).select(F.max(F.abs(2 * F.col("margin") - F.col("base_value") - total))).first()[0]
        assert off < 1e-9


def plain_statistics(rows, prior_weight):
    rate = sum(y or 0 for _, y, _ in rows) / len(rows)
    out = []
    for c, _, o in rows:
        before = [y or 0 for k, y, p in rows if k == c and p < o]
        out.append((c, o, round((sum(before) + prior_weight * rate) / (len(before) + prior_weight), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 6, 12])
def test_ordered_statistics_equal_a_plain_loop(spark, bits):
    rng = random.Random(bits)
    # A hot category, a null one, null labels, rows of equal order.
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), rng.choice([0, 1, 1, None]), rng.randrange(1 << EN.ORDER_BITS)) for _ in range(300)]
    rows += [(c, 1 - (y or 0), o) for c, y, o in rows[:40]]
    df = spark.createDataFrame(rows, "c string, y int, o long")
    got = EN.ordered_target_statistics(df, ["c"], "y", F.col("o"), 2.0, bits)
    assert got.columns == ["c", "y", "o", "c__ots"]
    assert sorted(((r.c, r.o, round(r.c__ots, 9)) for r in got.collect()), key=str) == plain_statistics(rows, 2.0)
    assert EN.ordered_target_statistics(df.limit(0), ["c"], "y", F.col("o")).count() == 0


def test_a_rows_own_label_is_never_in_its_statistic(spark):
    rows = [("x", i % 2, i * 7919 % 1000 << 50) for i in range(100)]
    flipped = [(c, 1 - y if i == 50 else y, o) for i, (c, y, o) in enumerate(rows)]
    own = rows[50][2]
    one, two = ({r.o: r.c__ots for r in EN.ordered_target_statistics(spark.createDataFrame(x, "c string, y int, o long"), ["c"], "y", F.col("o"), 0.0001).collect()}
                for x in (rows, flipped))
    # Flipping a label moves the global rate a little and the rows after it, not the row itself.
    assert abs(one[own] - two[own]) < 1e-4 and any(abs(one[o] - two[o]) > 1e-3 for o in one if o > own)


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got


def test_only_the_first_block_of_a_file_is_read():
    for length in (10, 1_000_000):
        f = Counted(b"\xef\xbb\xbfA,B\r\n" + b"1,2\r\n" * length)
        assert C.first_line(f, 64) == "A,B" and f.taken <= 64
    assert C.first_line(Counted(b"\n \r\n" * 50 + b"A,B"), 7) == "A,B"
    assert C.first_line(Counted(b"A," + b"x" * 500 + b"\n1"), 16) == "A," + "x" * 500
    assert C.first_line(Counted(b"A,B\r1,2\r"), 64) == "A,B" and C.first_line(Counted(b"\n\n")) is None and C.first_line(Counted(b"")) is None


def test_headers_by_prefix_equal_the_scan_of_lines(spark, tmp_path, monkeypatch):
    folder = tmp_path / "a b%20c+d"
    folder.mkdir()
    (folder / "f 1.csv").write_bytes(b"\xef\xbb\xbfA,B\r\n" + b"1,2\r\n" * 5)
    (folder / "g.csv").write_text("\n\nB,A\n3,4\n")
    (folder / "empty.csv").write_text("")
    (folder / "no.txt").write_text("C,D\n")
    def nothing_opens(batches):
        for b in batches:
            n = b.num_rows
            yield pa.record_batch({"path": b.column("path"), "header": pa.nulls(n, pa.string()), "opened": pa.array([False] * n)})

    by_prefix = C.header_groups(spark, str(tmp_path))
    assert sorted(by_prefix) == ["A,B", "B,A"]
    assert all(spark.read.text(p).count() > 0 for paths in by_prefix.values() for p in paths)
    with monkeypatch.context() as m:
        m.setattr(C, "_read_headers", nothing_opens)
        by_scan = C.header_groups(spark, str(tmp_path))
    assert {k: [p.rsplit("/", 1)[1] for p in v] for k, v in by_scan.items()} == {k: [p.rsplit("/", 1)[1] for p in v] for k, v in by_prefix.items()}
