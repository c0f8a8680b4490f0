import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helpers import MID, SMALL, duck_rows, spark_rows
from tarmac.llm import prefix_trie, queries
from tarmac.llm.prefix_trie import Parentheses, forked_trie, trie_values

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _order(turn):
    t, role, text = turn
    digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return (t is not None, t or 0, digest)


def _conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn, role or "", text or ""))
    return {c: [x[1:] for x in sorted(ts, key=_order)] for c, ts in out.items()}


def _forked(convs):
    out = {}
    for c, own in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def _brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for key in nodes:
        if key:
            kids.setdefault(key[:-1], []).append(key)

    def under(key):
        leaves, saved, todo = 0, 0, [key]
        while todo:
            k = todo.pop()
            todo += kids.get(k, [])
            leaves += k not in kids
            saved += (len(nodes[k]) - 1) * len(k[-1][1]) if k else 0
        return leaves, saved

    rows = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        rows.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(kids.get(key, [])), *under(key),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def _got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def _frame(spark, rows, extra=False):
    schema = "conv_id long, turn long, role string, text string"
    if extra:
        rows = [(*r, 3, "x", 1) for r in rows]
        schema += ", depth long, digest string, n int"
    return spark.createDataFrame(rows, schema)


def test_query_equals_sql(spark):
    assert spark_rows(queries.op13_prefix_trie(spark, MID)) == duck_rows(queries.SQL["op13_prefix_trie"], MID)


def test_query_equals_plain_tries(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(queries.op13_prefix_trie(spark, SMALL)) == _brute(_forked(_conversations(rows)))


@pytest.mark.parametrize("seed,parts,shard", [(1, "4", 1 << 18), (2, "7", 3), (3, "13", 11), (4, "1", 5)])
def test_random_tries_over_shards(spark, monkeypatch, seed, parts, shard):
    """Deep shared prefixes, a third of the conversations equal, a conversation with a third of the rows, small shards."""
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    monkeypatch.setattr(prefix_trie, "ENDS", 4)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 900), 120):
        turns = [("r", "same " * 3)] * 4 if rng.random() < 0.3 else [(rng.choice("ab"), rng.choice(["", "é", "xyz", "日本語"])) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rows += [(400, i, "u", rng.choice(["p", "qq"])) for i in range(300)]
    rows += [(401, i, *rows[-300 + i][2:]) for i in range(250)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = _frame(spark, rows).repartition(5)
        got = _got(forked_trie(df))
        turns = prefix_trie.turn_rows(df)
        plain = _got(prefix_trie.prefix_trie(turns, turns.select("conv").distinct()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == _brute(_forked(_conversations(rows)))
    assert plain == _brute(_conversations(rows))


def test_odd_rows(spark):
    rows = [(1, None, "u", "second"), (1, None, None, "first"), (1, 0, "u", None), (1, 0, "u", ""), (1, 0, "u", ""), (None, 1, "u", "nobody's"),
            (2, 5, "u", "x" * 100_000), (2, -5, "a:b", "c"), (3, 1, "a", ":bc"), (100, 0, "u", "base"), (150, 0, "u", "own"), (-7, 0, None, None), (-100, 1, "u", "n")]
    assert _got(forked_trie(_frame(spark, rows, True))) == _brute(_forked(_conversations(rows)))
    assert forked_trie(_frame(spark, rows).limit(0)).collect() == []
    lone = [(c, 0, "u", "gone") for c in (101, 102, 103, 104, 105, 106)]  # some lose their only turn and are turnless
    assert _got(forked_trie(_frame(spark, lone))) == _brute(_forked(_conversations(lone)))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 700), st.integers(0, 10 ** 6), st.sampled_from([0.3, 0.5, 0.9]))
def test_findclose_is_the_stack(pairs, seed, up):
    rng, bits, depth, opened = random.Random(seed), [], 0, 0
    while opened < pairs or depth:
        if opened < pairs and (not depth or rng.random() < up):
            bits, depth, opened = [*bits, 1], depth + 1, opened + 1
        else:
            bits, depth = [*bits, 0], depth - 1
    stack, close = [], {}
    for i, b in enumerate(bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    p = Parentheses(np.array(bits, np.uint8))
    got = p.findclose(p.opens)
    assert dict(zip(p.opens.tolist(), got.tolist())) == close
    inner = [sum(bits[k] and not bits[k + 1] for k in range(i, close[i])) for i in p.opens.tolist()]
    assert p.leaves(p.opens, got).tolist() == inner


def test_values_of_a_small_trie():
    a, b, c, d = (1, 3), (1, 1), (2, 1), (4, 1)
    nodes, leaves, saved = trie_values([[a, b], [a, c], [d]], [[5, 1], [9, 2], [7]])
    assert nodes == [a, b, c, d] and leaves.tolist() == [2, 1, 1, 1] and saved.tolist() == [8, 1, 2, 7]
    assert trie_values([], [])[0] == []


def test_no_task_gathers_a_conversation(spark):
    """The turns of a conversation are numbered and hashed by range, never grouped into a list."""
    turns = prefix_trie.turn_rows(spark.read.parquet(f"{MID}/conversations.parquet"))
    nodes = prefix_trie.prefix_trie(turns, turns.select("conv").distinct())
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
