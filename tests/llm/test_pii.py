import hashlib
import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import EDGE, MID, edge_docs, empty_docs
from tarmac.llm import queries
from tarmac.llm.pii_crf import LABELS, SkipChainCRF, base_spans, detect, edges, candidates, find_spans, joined, luhn, redact, train


def _plain(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("aZ09.@+-_% ()\n1234567890é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base_spans(text) == _plain(text)


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = queries.op7_skip_chain_pii(spark, MID).collect()
    assert len(rows) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    for r in rows:
        want = _plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in LABELS[1:]]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(","))


def test_edge_cases(spark):
    rows = detect(edge_docs(spark), None).collect()
    assert len(rows) == len(EDGE) and all(r.spans == joined(_plain(dict(EDGE).get(r.doc_id) or "")) for r in rows if r.doc_id != 5)
    assert detect(empty_docs(spark), None).collect() == []
    assert train(edge_docs(spark)) is None and train(empty_docs(spark)) is None
    slow = "1" * 300_000 + "." + "a" * 300_000 + "@" + "+" * 1000
    assert base_spans(slow) == []


def test_redaction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "mail a.b@x.org or +1 (504) 555-2652.", 9), (2, None, 8)], "doc_id long, text string, spans long")
    assert [tuple(r) for r in redact(df, None).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] or [PHONE].", 9), (2, None, 8)]


def _random(seed):
    rng = np.random.default_rng(seed)
    k = len(LABELS)
    skip = rng.normal(size=(k, k))
    return SkipChainCRF({f"f{i}": rng.normal(size=k) for i in range(6)}, rng.normal(size=(k, k)), skip + skip.T)


def test_messages_are_exact_on_a_tree():
    m = _random(1)
    feats = [[f"f{i}"] for i in range(4)]
    chain, skip = [(0, 1), (1, 2)], [(0, 3)]
    total = np.zeros((4, len(LABELS)))
    for y in itertools.product(range(len(LABELS)), repeat=4):
        w = np.exp(sum(m.node[f"f{i}"][y[i]] for i in range(4)) + sum(m.chain[y[a], y[b]] for a, b in chain) + m.skip[y[0], y[3]])
        for i, v in enumerate(y):
            total[i, v] += w
    want = total / total.sum(1)[:, None]
    assert np.allclose(m.marginals(feats, chain, skip, rounds=6), want)


def test_skip_links_make_labels_agree(spark):
    text = "a@b.org is here\n" + "\n".join(f"x a@b.org y{i}" for i in range(5))
    words = candidates(text)
    chain, skip = edges(text, words)
    same = [k for k, (s, e) in enumerate(words) if text[s:e] == "a@b.org"]
    assert [(a, b) for a, b in zip(same, same[1:])] == [p for p in skip if p[0] in same]
    card = next(f"{n:016d}" for n in range(4111111111110000, 4111111111120000) if luhn(f"{n:016d}"))
    docs = [f"pay {card} now" for _ in range(30)] + [f"code {i:07d} ok" for i in range(30)] + [f"card {card} and 12 {card} end" for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    model = train(df)
    base, every = find_spans([docs[-1]], model)[0]
    # The second number's match takes "12" in and fails; its skip link to the first says what it is.
    assert [docs[-1][s:e] for _, s, e in base] == [card] and [docs[-1][s:e] for _, s, e in every] == [card, card]
    plain = find_spans([docs[31]], model)[0]
    assert plain == ([], [])


def test_numbers_beside_base_spans_are_found(spark):
    cards = [n for n in (f"{n:016d}" for n in range(4111111111110000, 4111111111120000)) if luhn(n)]
    docs = [f"pay {cards[i]} now" for i in range(60)] + [f"code {i:07d} ok" for i in range(60)]
    docs += [f"host 10.0.0.{i} up" for i in range(40)] + [f"mail a{i}@x.org or" for i in range(40)]
    model = train(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))

    def found(text):
        base, every = find_spans([text], model)[0]
        assert set(base) <= set(every)
        return [(k, text[s:e]) for k, s, e in base], [(k, text[s:e]) for k, s, e in every]

    # The digits before a card join its base match, which then fails.
    for text, first in ((f"10.0.0.1 {cards[70]}", ("ip", "10.0.0.1")), (f"a@x.org {cards[70]} {cards[71]}", ("email", "a@x.org")),
                        (f"10.0.0.7 {cards[70]} {cards[71]}", ("ip", "10.0.0.7"))):
        base, every = found(text)
        assert base == [first]
        assert sorted(every) == sorted([first] + [("card", c) for c in cards[70:72] if c in text])
    text = f"10.0.0.1 {cards[70]} end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert redact(df, model).first().text == "[IP] [CARD] end"
