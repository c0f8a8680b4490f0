import collections
import random
import tracemalloc

from helpers import EDGE, MID, edge_docs, empty_docs
from tarmac.llm import queries
from tarmac.llm.bm25_leaks import BlockMaxIndex, find_leaks, in_order, items_for, question_answer, without_leaks, words_of


def _index(items, block=8):
    df = collections.Counter(w for _, t in items for w in set(words_of(t)))
    return BlockMaxIndex(items, df, len(items), sum(len(words_of(t)) for _, t in items) / len(items), block)


def _scores(ix, words):
    out = collections.defaultdict(float)
    for t in {ix.terms[w] for w in words if w in ix.terms}:
        for d, x in zip(*ix.postings[t]):
            out[d] += x
    return out


def test_block_max_wand_finds_all_above_the_threshold():
    rng = random.Random(3)
    vocab = [f"v{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 50)))) for i in range(150)]
    for block in (1, 4, 16):
        ix = _index(items, block)
        for threshold in (0.1, 0.3, 0.6):
            for _ in range(40):
                words = rng.choices(vocab, k=60) + words_of(rng.choice(items)[1])[:rng.randint(0, 30)]
                terms = sorted({ix.terms[w] for w in words if w in ix.terms})
                got = {d: s for d, s in ix.search(terms, threshold)}
                want = {d: s for d, s in _scores(ix, words).items() if s >= threshold}
                assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in got)


def test_passage_bounds_lose_no_candidate():
    rng = random.Random(5)
    vocab = [f"v{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(8, 50)))) for i in range(90)]
    ix = _index(items)
    step = max(64, ix.longest)
    for _ in range(40):
        words = rng.choices(vocab, k=rng.randint(1, 700))
        got = {(d, p) for d, p, _, _ in ix.candidates(words, 0.25)}
        want = {(d, p) for p in range(max(1, -(-len(words) // step) - 1))
                for d, s in _scores(ix, words[p * step:(p + 2) * step]).items() if s >= 0.25}
        assert got == want


def test_query_finds_every_verbatim_item(spark):
    rows = queries.op1_bm25_leaks(spark, MID).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{MID}/benchmark.parquet").collect()}
    clean = lambda t: " " + " ".join(words_of(t)) + " "
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if clean(x) in clean(t)}
    assert want and {(r.doc_id, r.item_id) for r in rows} == want


def test_partial_leaks_and_edge_cases(spark):
    q = "Which of the seven rivers named here runs north through the old city of glass? The river Orlan, the longest one."
    items = spark.createDataFrame([(1, q), (2, None), (3, ""), (None, "Only one sentence of some words that nobody else would say"), (1, q)],
                                  "item_id long, text string")
    only_question = q.split("?")[0]
    rng = random.Random(1)
    noise = lambda n: " ".join(rng.choices(["lorem", "ipsum", "dolor", "sit", "amet", "river"], k=n))
    docs = spark.createDataFrame([(1, noise(500) + " " + q.upper() + " " + noise(99)), (2, noise(30) + only_question + noise(30)),
                                  (3, " ".join(sorted(words_of(q)))), (4, None), (5, noise(5000)),
                                  (6, "x only one sentence of some words that nobody else would say!")], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items).collect()) == [(1, 1), (1, 1), (6, -1)]
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, items, max_items=1).collect()) == [(1, 1), (1, 1), (6, -1)]
    assert sorted(r.doc_id for r in without_leaks(docs, items).collect()) == [2, 3, 4, 5]
    assert find_leaks(edge_docs(spark), items).collect() == [] and find_leaks(empty_docs(spark), items).collect() == []
    assert find_leaks(docs, items.limit(0)).collect() == []
    assert without_leaks(edge_docs(spark), items).count() == len(EDGE)


def test_question_and_answer():
    assert question_answer("Who? Me.") == ("Who?", " Me.")
    assert question_answer("A b. C d. E f.") == ("A b. C d.", "E f.")
    assert question_answer("One sentence") == ("One sentence", "")


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_words_in_order_equal_the_plain_table():
    rng = random.Random(8)
    for _ in range(300):
        part, words = rng.choices("abcdef", k=rng.randint(1, 12)), rng.choices("abcdefgh", k=rng.randint(0, 60))
        n = len(part)
        at = range(0, max(1, len(words) - 2 * n + 1), n)
        assert in_order(part, words) == max(_lcs(part, words[k:k + 3 * n]) for k in at)
        assert in_order(part, words) >= max(_lcs(part, words[k:k + 2 * n]) for k in range(len(words) + 1))


def test_one_changed_word_in_every_position():
    items = [(i, r.text) for i, r in enumerate(_items())] + [(-1, "Which river runs north through the old glass city? The long Orlan.")]
    ix = _index(items)
    rng = random.Random(2)
    noise = lambda n: rng.choices(["zzlorem", "zzipsum", "zzdolor"], k=n)
    lost, tried = [], 0
    for d, (_, text) in enumerate(items):
        words = words_of(text)
        if len(words) < 6:
            continue
        copies = [[*words[:k], "zzchanged", *words[k + 1:]] for k in range(len(words))]
        if "?" not in text:
            copies += [words[:-1], words[:-2]]
        for copy in copies:
            text = " ".join(noise(70) + copy + noise(70))
            if any(x[0] == d for x in ix.candidates(words_of(text), 0.6)):
                tried += 1
                if d not in ix.leaks(text, 0.6, 0.5):
                    lost.append((d, copy))
    assert tried > 1000 and not lost


def _items():
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{MID}/benchmark.parquet").to_pylist()
    return [type("Item", (), r) for r in rows]


def test_long_texts_and_large_benchmarks_take_bounded_memory():
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.choices(vocab, k=20))) for i in range(4000)]
    ix = _index(items)
    words = [w for _ in range(4) for _, t in rng.sample(items, 500) for w in words_of(t)]
    words[9000:9000] = ["zz"] * 1000
    step = max(64, ix.longest)
    want = {(d, p) for p in range(max(1, -(-len(words) // step) - 1))
            for d, s in _scores(ix, words[p * step:(p + 2) * step]).items() if s >= 0.6}
    assert {x[:2] for x in ix.candidates(words, 0.6)} == {x[:2] for x in ix.candidates(words, 0.6, run_bytes=1)} == want
    tracemalloc.start()
    ix.candidates(words, 0.6, run_bytes=1 << 20)
    # The rows of all halves at once are 40,000 x 500 x 4 bytes.
    assert tracemalloc.get_traced_memory()[1] < 3e7
    tracemalloc.stop()
    assert items_for(1 << 27, 50_000, 30) * 50_000 // 8 * 4 <= 1 << 27
    assert items_for(1 << 27, 10 ** 9, 30) ** 2 * 30 // 8 * 4 <= 1 << 27
