import binascii

import numpy as np

from helpers import EDGE, MID, edge_docs, empty_docs
from tarmac.llm import queries
from tarmac.llm.pu_toxicity import Model, Rows, features, fit_nnpu, score, toxicity, train, without_toxic


def test_query_on_held_out_rows(spark):
    sf = MID.replace("sf0.01", "sf0.1")
    rows = queries.op9_nnpu_toxicity(spark, sf).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, toxic[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in toxic]
    pos, neg = [s for _, t, s in held if t], [s for _, t, s in held if not t]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc > 0.93
    assert sum(p for p, t, _ in held if t) >= 0.8 * len(pos) and sum(p for p, t, _ in held if not t) <= 0.01 * len(neg)


def test_non_negative_risk_recovers_the_prior():
    rng = np.random.default_rng(0)
    k, n, prior = 20, 4000, 0.2
    y = rng.random(n) < prior
    x = rng.random((n, k)) < np.where(y[:, None], np.r_[[0.6] * 5, [0.1] * 15], 0.1)
    p = rng.random((1000, k)) < np.r_[[0.6] * 5, [0.1] * 15]
    pack = lambda a: Rows(*np.nonzero(a), len(a))
    w, b = fit_nnpu(pack(p), pack(x), k, prior)
    said = x @ w + b > 0
    assert (said == y).mean() > 0.9 and w[:5].min() > w[5:].max()


def test_edge_cases(spark):
    none = spark.createDataFrame([(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity(edge_docs(spark), none).collect()
    assert len(rows) == len(EDGE) and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert toxicity(empty_docs(spark), none).collect() == []
    model = Model({"bad": 5.0, "^foul": 5.0}, -2.0, 0.1)
    df = spark.createDataFrame([(1, "Bad!", 0), (2, "fouled", 0), (3, None, 0), (4, "badly", 0)], "doc_id long, text string, predicted int")
    assert {r.doc_id: r.predicted for r in score(df, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 0}
    assert [tuple(r) for r in without_toxic(df, model).orderBy("doc_id").collect()] == [(3, None, 0), (4, "badly", 0)]
    assert train(empty_docs(spark), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")) is None
    assert features("Abcdefg x1y") == {"abcdefg", "^abcd", "^abcde", "^abcdef", "x", "y"}
