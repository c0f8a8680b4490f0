import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helpers import EDGE, MID, SMALL, duck_rows, edge_docs, empty_docs, spark_rows
from tarmac.llm import queries, resample
from tarmac.llm.runs import running

LOWER = {c: c + 32 for c in range(65, 91)}


def _features(text, longest=2):
    words = [w for w in re.split(resample.BETWEEN, (text or "").translate(LOWER)) if w]
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _bucket(f):
    return zlib.crc32(f.encode()) % 10_000


def _brute(docs, target, percent=25, least=20, longest=2):
    """(id, n_features, weight, score, rank, n_words) by plain loops."""
    s = Counter(_bucket(f) for _, t in docs for f in _features(t, longest)[1])
    t = Counter(_bucket(f) for x in target for f in _features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, text in docs:
        words, feats = _features(text, longest)
        w = sum(gain(_bucket(f)) for f in feats) // len(feats) if feats else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(feats), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    live = sorted((r for r in rows if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(live[:percent * len(live) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows), key=str)


def _got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_sql(spark):
    assert spark_rows(queries.op11_importance(spark, MID)) == duck_rows(queries.SQL["op11_importance"], MID)


def test_query_equals_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert _got(queries.op11_importance(spark, SMALL)) == _brute(docs, target)


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_odd_rows(spark, longest):
    target = spark.createDataFrame([("Three word four WORD",), (None,), ("",)], "text string")
    got = resample.importance(edge_docs(spark), target, longest=longest, least_words=1, percent=50)
    assert _got(got) == _brute(EDGE, ["Three word four WORD", None, ""], 50, 1, longest)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.importance(empty_docs(spark), none).collect() == []
    assert _got(resample.importance(edge_docs(spark), none, least_words=1)) == _brute(EDGE, [], 25, 1)


def test_drawn_documents_keep_their_columns(spark):
    docs = edge_docs(spark)
    target = spark.createDataFrame([("one two three",)], "text string")
    kept = resample.resample(docs, target, least_words=1, percent=60)
    ids = {r.doc_id for r in resample.importance(docs, target, least_words=1, percent=60).collect() if r["rank"]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == ids != set()


def test_a_third_of_the_rows_repeat_one_id(spark):
    rng = random.Random(4)
    docs = [(7, " ".join(rng.choices("abc", k=20)))] * 300 + [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(15, 30)))) for i in range(600)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got, want = _got(resample.importance(df, spark.createDataFrame([("a b a b",)], "text string"))), _brute(docs, ["a b a b"])
    assert got == want


def test_codes_of_runs_are_crcs():
    texts = pa.array(["A b a B", None, "", "é-日本 x", "  ", "a b"])
    for n, (owner, run, crc) in enumerate(resample.coded_runs(texts, 3), 1):
        want = [(k, zlib.crc32(f.encode())) for k, t in enumerate(texts.to_pylist()) for f in _features(t, 3)[1] if f.count(" ") == n - 1]
        assert list(zip(owner.tolist(), crc[run].tolist())) == want
        assert len(set(run.tolist())) == len(crc)


@pytest.mark.parametrize("parts", ["1", "3", "17"])
def test_running_totals_over_partitions(spark, parts):
    """A hot key over many partitions, keys that end at a border, single rows."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rng = random.Random(int(parts))
    rows = [(5, i, rng.randrange(100), rng.getrandbits(62)) for i in range(400)]
    rows += [(k, i, rng.randrange(100), -rng.getrandbits(62)) for k in (-3, 1, 2, 9) for i in range(rng.randint(1, 60))] + [(k, 0, 1, k) for k in range(20, 60)]
    rng.shuffle(rows)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.createDataFrame(rows, "k long, i long, a long, x long").repartition(5)
        got = {(r.k, r.i): (r.place, r.a, r.x) for r in running(df, "k", [F.asc("i")], add=("a",), xor=("x",)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want, totals = {}, {}
    for k, i, a, x in sorted(rows):
        n, s, y = totals.get(k, (0, 0, 0))
        want[k, i] = totals[k] = (n + 1, s + a, y ^ x)
    assert got == want
    assert running(df.limit(0), "k", [F.asc("i")]).collect() == []
