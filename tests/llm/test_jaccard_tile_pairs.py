"""Candidate pairs of the Jaccard tiles: in proportion to components, and none lost."""

import numpy as np
import pyarrow as pa

from tarmac.llm import jaccard_tiles as J


def tile(sets, comps):
    """A tile of one block as the rows that ``candidate_pairs`` takes."""
    bits = [J.bitmap(np.sort(np.array(s, np.uint64))) for s in sets]
    return [(7, 0, 0, 0, 0, k, len(s), bytearray(b), c) for k, (s, b, c) in enumerate(zip(sets, bits, comps))]


SCHEMA = "tile long, i int, j int, turn int, block int, sid long, n long, bits binary, comp long"


def near_copies(count):
    base = [int(x) << 20 for x in np.random.default_rng(3).permutation(1 << 20)[:200]]
    return [base[:195] + [(x * 5 + k + (1 << 21)) << 20 for k in range(5)] for x in range(count)]


def test_two_large_components_make_few_pairs(spark):
    rows = tile(near_copies(120), [0] * 60 + [1] * 60)
    found = J.candidate_pairs(spark.createDataFrame(rows, SCHEMA), 80)
    assert found.where("NOT more").count() <= 4  # was 4 for each row
    assert found.where("more").collect()[0]["turn"] == 1


def test_last_turn_takes_every_pair(spark):
    rows = [(*r[:3], 2, *r[4:]) for r in tile(near_copies(30), range(30))]
    found = J.candidate_pairs(spark.createDataFrame(rows, SCHEMA), 80)
    assert found.where("more").count() == 0
    assert found.count() == 30 * 29 // 2


def test_a_pair_of_two_tiles_is_made_once(spark):
    rows = tile(near_copies(2), [0, 1])
    rows += [(8, *r[1:]) for r in rows]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert J.candidate_pairs(spark.createDataFrame(rows, SCHEMA), 80).where("NOT more").count() == 1
    finally:
        spark.conf.unset("spark.sql.shuffle.partitions")


def test_best_of_each():
    a, b = np.array([1, 1, 1, 2]), np.array([2, 2, 3, 3])
    assert J.best_of_each(a, b, 1).tolist() == [True, False, True, False]
    assert J.best_of_each(a[:0], b[:0], 1).tolist() == []


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"w{k}" for k in range(4000)])
    texts = []
    for g in range(6):  # groups of near copies, some of them not near enough
        base = rng.choice(words, 80)
        for _ in range(40):
            t = base.copy()
            for at in rng.choice(80, rng.integers(0, 4), replace=False):
                t[at] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", texts[0], "one word"]
    sets = [J.shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for y in range(len(texts)):
        for x in range(y):
            if len(sets[x]) and len(sets[y]) and J.linked(sets[x], sets[y], 80):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(docs).collect()}
    assert got == {k: find(k) for k in range(len(texts))}
