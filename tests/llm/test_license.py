import random
import re
import textwrap
from collections import Counter

import pytest

from helpers import MID, SMALL, duck_rows, edge_docs, empty_docs, spark_rows
from tarmac.llm import queries
from tarmac.llm.license_dice import NOTICES, TEMPLATES, scan, template_bigrams


@pytest.mark.parametrize("sf", [SMALL, MID])
def test_query_equals_sql(spark, sf):
    got, want = spark_rows(queries.op6_license_dice(spark, sf)), duck_rows(queries.SQL["op6_license_dice"], sf)
    assert got == want and any(r["license"] for r in got)


def _scan(spark, texts):
    return [(r.license, r.n_units, r.dice) for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_notices_whole_split_changed_and_absent(spark):
    mit = dict((k, t) for k, t in TEMPLATES[::-1])["MIT"]
    whole = next(t for k, t in TEMPLATES if k == "MIT" and "hereby" in t)
    cut = whole.replace("to any person", "to any person\n").replace("this software", "this\nsoftware")
    got = _scan(spark, ["** released UNDER the mit-license **", cut, "Licensed under CC BY-ND 4.0.", "released under the", "a\n" + mit.upper(), "mit " * 500])
    assert [g[:2] for g in got] == [("MIT", 1), ("MIT", 1), (None, 0), (None, 0), ("MIT", 2), (None, 0)]
    assert got[0][2] == 1.0


def test_edge_cases_and_native_plan(spark):
    rows = scan(edge_docs(spark)).collect()
    assert len(rows) == 11 and all(r.license is None and r.n_units == 0 for r in rows)
    assert scan(empty_docs(spark)).collect() == []
    plan = queries.op6_license_dice(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_notices_wrapped_or_inside_a_longer_line(spark):
    prose = "Some text of another kind stands here, of many words that no notice has, and goes on and on. " * 3
    texts, want = [], []
    for name, notice in NOTICES:
        wrapped = "\n".join(" * " + x for x in textwrap.wrap(notice, 76))
        texts += [f"{prose}\n/*\n{wrapped}\n */\n{prose}", f"{prose}{notice} {prose}", f"{wrapped}\n{wrapped}\n{prose}"]
        want += [name] * 3
    got = _scan(spark, texts)
    assert [g[0] for g in got] == want and all(g[2] == 1.0 for g in got)
    # BSD's first paragraph is a template, and Apache's first line one that matches by itself.
    assert all(g[1] >= 1 for g in got) and [g[1] for g, k in zip(got[2::3], want[2::3]) if k in ("GPL-3.0", "MIT", "ISC")] == [2, 2, 2, 2]
    assert _scan(spark, [prose, prose + "\n" + prose]) == [(None, 0, None)] * 2


def _plain(text, templates):
    grams, best = template_bigrams(text), []
    for name, t in templates:
        own = Counter(template_bigrams(t))
        n = own.total()
        for s in range(len(grams)):
            for e in range(s + 1, len(grams) + 1):
                d = 2 * (Counter(grams[s:e]) & own).total() / (e - s + n)
                if d >= 0.8 - 1e-12:
                    best.append((-d, name))
    return (min(best)[1], -min(best)[0]) if best else (None, None)


def test_windows_equal_all_windows(spark):
    rng = random.Random(4)
    templates = [("x", "a b a b c d"), ("y", "c d e f a b c d"), ("z", "f f f f f a")]
    texts = [" ".join(rng.choices("abcdefg", k=rng.randint(0, 40))) for _ in range(60)]
    for _ in range(90):
        words = rng.choice(templates)[1].split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice("abcdefg")
        words = rng.choices("abcdefg", k=rng.randint(0, 9)) + words + rng.choices("abcdefg", k=rng.randint(0, 9))
        texts.append("".join(w + rng.choice("  \n") for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan(df, templates=templates[:1], notices=templates[1:]).orderBy("doc_id").collect()
    want = [_plain(t, templates) for t in texts]
    assert [(r.license, r.dice and round(r.dice, 9)) for r in rows] == [(k, d and round(d, 9)) for k, d in want]
    assert all((r.n_units > 0) == (r.license is not None) for r in rows) and 20 < sum(k is not None for k, _ in want) < 140
