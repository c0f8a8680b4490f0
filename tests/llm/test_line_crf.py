import collections
import itertools
import re

import numpy as np

from helpers import EDGE, MID, edge_docs, empty_docs
from tarmac.llm import queries
from tarmac.llm.line_crf import LineCRF, fit_crf, judge, repeated_words, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _base(text):
    words = WORD.findall(text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    again = {j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again),
            n < 50 or 100 * len(again) > 50 * n)


def test_base_measures_and_verdicts_on_all_documents(spark):
    rows = queries.op4_line_crf(spark, MID).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == _base(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    judged = [(r.kept, quality[r.doc_id]) for r in rows if r.doc_id in quality and not r.base_failed]
    assert sum(k == bool(q) for k, q in judged) >= 0.97 * len(judged)


def test_edge_cases(spark):
    got = judge(edge_docs(spark), None).collect()
    key = lambda r: str(r)
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((i, *_base(t)) for i, t in EDGE), key=key)
    assert judge(empty_docs(spark), None).collect() == []
    no_labels = spark.createDataFrame([(None, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    assert train(edge_docs(spark), no_labels) is None


def test_repeated_words_by_hand():
    assert repeated_words("a b c a b c".split()) == 6
    assert repeated_words("a a a a".split()) == 4
    assert repeated_words("a b c d a b c".split()) == 6
    assert repeated_words("a b".split()) == 0


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        m = LineCRF(rng.normal(size=(2, 4)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(n, 4))
        s = x @ m.emit.T
        value = lambda y: m.first[y[0]] + sum(s[i, k] for i, k in enumerate(y)) + sum(m.move[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert abs(value(m.viterbi(x)) - value(best)) < 1e-9


def test_fit_learns_transitions():
    rng = np.random.default_rng(5)
    seqs = []
    for _ in range(200):
        y = np.cumsum(rng.random(int(rng.integers(3, 12))) < 0.1) % 2
        x = np.column_stack([np.ones(len(y)), y * 0.8 + rng.normal(size=len(y)) * 0.5])
        seqs.append((x, y))
    m = fit_crf(seqs)
    assert m.move[0, 0] + m.move[1, 1] > m.move[0, 1] + m.move[1, 0]
    total = sum(len(y) for _, y in seqs)
    right = sum((np.array(m.viterbi(x)) == y).sum() for x, y in seqs) / total
    alone = sum(((x[:, 1] > 0.4) == y).sum() for x, y in seqs) / total
    assert right > alone + 0.05
