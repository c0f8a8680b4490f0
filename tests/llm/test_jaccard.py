import collections
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import EDGE, MID, SMALL, duck_rows, edge_docs, empty_docs, spark_rows
from tarmac.llm import jaccard_tiles, queries
from tarmac.llm.components import components
from tarmac.llm.jaccard_tiles import bitmap, bits_for, close_pairs, jaccard_components, one_of_each, shingles


def _words(text):
    return (text or "").encode().lower().split()


def _shingles(text):
    w = _words(text)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def _brute(rows):
    """(id, n, component) by comparing all pairs."""
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_size = sorted((x for x in sets if x[0] is not None and x[1]), key=lambda x: len(x[1]))
    for k, (a, s) in enumerate(by_size):
        for b, o in by_size[k + 1:]:
            if 4 * len(o) > 5 * len(s):
                break
            both = len(s & o)
            if 100 * both >= 80 * (len(s) + len(o) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def _got(df, **k):
    return sorted((tuple(r) for r in jaccard_components(df, **k).collect()), key=str)


@pytest.mark.parametrize("sf", [SMALL, MID])
def test_query_equals_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op10_jaccard_tiles(spark, sf).collect()), key=str) == _brute(rows)


def test_query_equals_sql(spark):
    assert spark_rows(queries.op10_jaccard_tiles(spark, MID)) == duck_rows(queries.SQL["op10_jaccard_tiles"], MID)


def test_groups_of_near_copies_over_many_blocks(spark, monkeypatch):
    """Chains at the edge of the threshold, a hot group, a shared passage; blocks and rounds are forced small."""
    monkeypatch.setattr(jaccard_tiles, "BLOCK", 8)
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    base = rng.choices(vocab, k=150)
    passage = rng.choices(vocab, k=60)
    texts = []
    for _ in range(70):  # near copies of one text, at and about the threshold
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    chain = rng.choices(vocab, k=120)
    for _ in range(25):  # each near the one before only
        chain = chain[6:] + rng.choices(vocab, k=6)
        texts.append(" ".join(chain))
    texts += [" ".join(passage + rng.choices(vocab, k=rng.randint(5, 80))) for _ in range(60)]
    texts += [" ".join(rng.choices(vocab[:3], k=rng.randint(1, 12))) for _ in range(60)]
    rows = list(enumerate(texts + texts[:40]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert _got(df) == _brute(rows)


def test_edge_cases(spark):
    want = _brute([r for r in EDGE if r[0] != 5] + [(5, "one two three")])
    got = _got(edge_docs(spark))
    assert sorted(set(got), key=str) == want and len(got) == len(EDGE)
    assert jaccard_components(empty_docs(spark)).collect() == []
    clashing = edge_docs(spark).withColumns({"_id": F.lit(1), "_again": F.lit("x"), "gone": F.lit(True)})
    kept = one_of_each(clashing)
    assert kept.columns == clashing.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8", "9", "10"])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 120), st.integers(0, 120))
def test_bitmaps_never_lose_a_pair(common, only_a, only_b):
    rng = np.random.default_rng(common * 7 + only_a)
    s = rng.integers(0, 1 << 63, common + only_a + only_b, dtype=np.uint64)
    a, b = np.unique(s[:common + only_a]), np.unique(np.concatenate([s[:common], s[common + only_a:]]))
    row = lambda x: np.frombuffer(bitmap(x), np.uint64)[None]
    x, _, _ = close_pairs(np.array([len(a)]), row(a), np.array([len(b)]), row(b), 80)
    both = len(np.intersect1d(a, b))
    assert len(x) == 1 or 100 * both < 80 * (len(a) + len(b) - both)
    assert bits_for(len(a)) >= 4 * len(a) or bits_for(len(a)) == jaccard_tiles.MAX_BITS


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10 ** 6))
def test_similar_sets_share_as_many_keys_as_stated(common, only_a, only_b, seed):
    ranks = random.Random(seed).sample(range(10 ** 6), common + only_a + only_b)
    a, b = ranks[:common + only_a], ranks[:common] + ranks[common + only_a:]
    if 100 * common >= 80 * len(ranks):
        keys = [set(sorted(x)[:jaccard_tiles.prefix_size(len(x), 80)]) for x in (a, b)]
        assert len(keys[0] & keys[1]) >= jaccard_tiles.least_keys(len(a), len(b), 80) >= 1


def test_shingles_are_of_whole_ascii_words():
    assert len(shingles("A b\tC d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles(" \n")) == 0
    assert (shingles("A B c d e") == shingles("a b C D E")).all() and (shingles("É a") != shingles("é a")).all()
    assert (shingles("a b") != shingles("a b")).all()


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1300)] + [(2000, x) for x in range(2001, 2300)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: find(x) for x in linked}
    assert collections.Counter(got.values())[2000] == 300
