import collections
import itertools
import re

from pyspark.sql import functions as F

from helpers import SMALL
from tarmac.llm import queries
from tarmac.llm.url_rules import BAD, RULES, host_of, judge_urls, match_rules, mine_rules, path_of, tokens_of

URLS = [None, "", "no scheme/x", "http://A.Example.ORG/es/x", "https://example.org", "x://y://z/w", "http://é.ORG/q?r", "a://org/",
        "http://badorg/x", "http://x.com/fr/1", "http://x.com/de/1?a", "http://com/de/", "http://x.net/de/#f", "http://h\n/p\nq#z",
        "http://example.org/en/12", "http://example.org/es/?://com/fr/"]


def _plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def _pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("h")) \
        .withColumn("tokens", F.lit(1)).withColumn("verdict", F.lit("x"))


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_given_rules_and_edge_cases(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(_pages(spark, URLS), _labels(spark, [(None, 0, 0), (1, None, None)])).collect()}
    want = {i: _plain(u) for i, u in enumerate(URLS)}
    assert got == {i: w[:3] + (w[3] or "allow",) for i, w in want.items()}
    assert judge_urls(_pages(spark, []).limit(0), _labels(spark, [])).collect() == []


def test_query_over_whole_table(spark):
    rows = queries.op3_url_rules(spark, SMALL).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule, verdict = _plain(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (rule is None or r.verdict == verdict)


def test_mined_rules_equal_brute_force(spark):
    urls = [f"http://{h}.test/{p}/{i}" for i in range(60) for h, p in [(["spam", "good", "mixed"][i % 3], ["a", "b"][i % 2])]]
    bad = [("spam" in u) or ("mixed" in u and "/a/" in u) for u in urls]
    pages = _pages(spark, urls + urls[:1])
    labels = _labels(spark, [(i, 0 if b else 1, 0) for i, b in enumerate(bad)] + [(0, None, 1), (3, 1, 1)])
    bad[3] = True
    known = [set(r.t) for r in _pages(spark, urls).select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("t")).collect()]
    pairs = [(t, b) for t, b in zip(known, bad)]
    n, hits = collections.Counter(), collections.Counter()
    for t, b in pairs:
        for k in range(1, len(t) + 1):
            for c in itertools.combinations(sorted(t), k):
                n[c] += 1
                hits[c] += b
    rules = {c: hits[c] / n[c] for c in n if hits[c] >= 5 and hits[c] / n[c] >= 0.8}
    kept = {c: x for c, x in rules.items() if not any(set(o) < set(c) and rules[o] >= x for o in rules)}
    mined = mine_rules(pages, labels, min_support=5, min_confidence=0.8)
    got = {tuple(r.tokens): round(r.confidence, 9) for r in mined.collect()}
    assert got == {c: round(x, 9) for c, x in kept.items()} and len(got) >= 2
    sets = spark.createDataFrame([(i, sorted(t)) for i, t in enumerate(known)], "set_id long, tokens array<string>")
    fired = {r.set_id for r in match_rules(sets, mined, "set_id").collect()}
    assert fired == {i for i, t in enumerate(known) if any(set(c) <= t for c in kept)}
    verdicts = {r.page_id: r.verdict for r in judge_urls(pages, labels, min_support=5).collect()}
    assert all(verdicts[i] == ("block" if i in fired else "allow") for i in range(60))


def test_native_plan(spark):
    plan = queries.op3_url_rules(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and BAD


def test_toxic_without_quality_and_exact_support(spark):
    # Of 147 pages 20 are bad, all by toxic alone; 20 / 147 * 147 is above 20 in floating point.
    pages = _pages(spark, [f"http://{'spam' if i < 20 else 'good'}.test/{i}" for i in range(147)])
    labels = _labels(spark, [(i, None, 1) if i < 20 else (i, 1, None) for i in range(147)])
    rules = mine_rules(pages, labels, min_support=20)
    assert [(r.tokens, r.support) for r in rules.collect()] == [(["h:spam"], 20)]
    assert mine_rules(pages, labels, min_support=21).collect() == []
