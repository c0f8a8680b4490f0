import random

import numpy as np
from pyspark.sql import functions as F

from helpers import EDGE, MID, SMALL, duck_rows, edge_docs, empty_docs, spark_rows
from tarmac.llm import lsh_forest, queries
from tarmac.llm.common import table
from tarmac.llm.jaccard_tiles import jaccard_components
from tarmac.llm.lsh_forest import DEPTH, TREES, alike_rows, near_copies, neighbours, one_of_each, region_links, signature


def _shingles(text, k=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def _brute(rows, percent=85):
    sets = [(i, _shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    live = sorted((x for x in sets if x[0] is not None and x[1]), key=lambda x: len(x[1]))
    for k, (a, s) in enumerate(live):
        for b, o in live[k + 1:]:
            if percent * len(o) > 100 * len(s):
                break
            both = len(s & o)
            if 100 * both >= percent * (len(s) + len(o) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


def _got(df):
    return sorted((tuple(r) for r in near_copies(df).collect()), key=str)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    assert sorted(map(tuple, queries.op12_lsh_forest(spark, SMALL).collect()), key=str) == _brute(rows)


def test_query_equals_sql(spark):
    assert spark_rows(queries.op12_lsh_forest(spark, MID)) == duck_rows(queries.SQL["op12_lsh_forest"], MID)


def test_groups_of_near_copies(spark):
    """A hot group of distinct near copies, chains at the threshold, documents that share a passage."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(4000)]
    base, passage, chain = rng.choices(vocab, k=160), rng.choices(vocab, k=60), rng.choices(vocab, k=150)
    texts = []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(40):
        chain = chain[5:] + rng.choices(vocab, k=5)
        texts.append(" ".join(chain))
    texts += [" ".join(passage + rng.choices(vocab, k=rng.randint(5, 80))) for _ in range(150)]
    texts += [" ".join(rng.choices(vocab[:3], k=rng.randint(1, 12))) for _ in range(150)]
    rows = list(enumerate(texts + texts[:200]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert _got(df) == _brute(rows)


def test_same_components_as_the_exact_join(spark):
    docs = table(spark, MID, "documents")
    want = {r.doc_id: r.component_id for r in jaccard_components(docs, k=3, percent=85).collect()}
    assert {r.doc_id: r.component_id for r in near_copies(docs).collect()} == want


def test_candidates_are_linear_in_the_rows(spark, monkeypatch):
    """Equal hashes in all rows, the worst case: every row has ``reach`` candidates to a side wherever cells and partitions are cut."""
    monkeypatch.setattr(lsh_forest, "CELL", 8)
    rows = spark.range(500).select(F.lit(0).alias("tree"), F.lit(b"\x01" * 4 * DEPTH).alias("hashes"), F.col("id").alias("sid"), F.col("id").alias("comp"))
    found = neighbours(rows.repartition(4), 3)
    assert {(r.a, r.b) for r in found.collect()} == {(i, i + w) for w in (1, 2, 3) for i in range(500 - w)}
    assert neighbours(rows.withColumn("comp", F.lit(0).cast("long")), 3).count() == 0
    assert neighbours(rows.limit(0), 3).count() == 0


def test_long_regions_equal_all_pairs(spark, monkeypatch):
    """Copies with few and with many changes, so that many pairs lie about the threshold, in regions far longer than the reach."""
    monkeypatch.setattr(lsh_forest, "ROUNDS", ((1, 1), (11, 1)))
    monkeypatch.setattr(lsh_forest, "CELL", 32)
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(4000)]
    base, rows = rng.choices(vocab, k=150), []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    assert _got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == _brute(rows)


def test_regions_give_fewer_links_than_rows(spark):
    """All rows alike: one link fewer than rows; sets that are not similar give none; rows of one component are left alone."""
    n, s = 300, np.arange(100, dtype=np.uint64)
    rows = [(0, bytes(4 * DEPTH), i, i, bytes(4 * TREES * DEPTH), bytes(TREES * DEPTH), (s + np.uint64(i % 3)).tobytes()) for i in range(n)]
    df = spark.createDataFrame(rows, "tree int, hashes binary, sid long, comp long, sig binary, low binary, s binary").repartition(4)
    narrow = df.drop("sig", "s")
    assert alike_rows(narrow, 1024).count() == n and alike_rows(narrow.withColumn("comp", F.lit(7).cast("long")), 1024).count() == 0
    links = [(r.u, r.v) for r in region_links(df, 1024, 85).collect()]
    parent = dict(zip(range(n), range(n)))
    for u, v in links:
        parent = {k: parent[u] if r == parent[v] else r for k, r in parent.items()}
    assert len(links) == n - 1 and len(set(parent.values())) == 1
    assert region_links(df, 1024, 100).count() == n - 3
    assert region_links(df.withColumn("tree", F.lit(1)), 1024, 85).count() == 0  # tree 0 has these pairs


def test_shared_hashes_estimate_the_similarity():
    rng = np.random.default_rng(3)
    s = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    same = np.mean([(signature(s[200 * k:200 * k + 170]) == signature(np.concatenate([s[200 * k:200 * k + 155], s[200 * k + 185:200 * k + 200]]))).mean() for k in range(30)])
    assert abs(same - 155 / 185) < 0.02 and len(signature(s)) == TREES * DEPTH
    assert (signature(s, 100) == signature(s)).all()


def test_odd_rows(spark):
    want = _brute([r for r in EDGE if r[0] != 5] + [(5, "one two three")])
    got = _got(edge_docs(spark))
    assert sorted(set(got), key=str) == want and len(got) == len(EDGE)
    assert near_copies(empty_docs(spark)).collect() == [] and one_of_each(empty_docs(spark)).collect() == []
    kept = one_of_each(edge_docs(spark).withColumns({"_id": F.lit(1), "_gone": F.lit("x"), "component_id": F.lit(2)}))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "7", "8", "9", "10"])
