"""Trie of conversation prefixes in balanced parentheses, sharded (operator 13).

A node is a distinct sequence of first turns.  Its key is the depth with 128 bits, the exclusive or of a hash of every
turn with its place, so prefixes are running totals (``runs.running``, no task holds a conversation) and a node's
key less its last turn is its parent's.

* Chains.  Nodes below each other with the same members are one chain, told by its smallest member and its number of
  members.  A chain's tree values follow from those of its top and the characters in between, so only
  chains go into the trie.  A conversation passes at most the square root of twice the number of turns of all conversations.
* Shards.  The paths of the chains without children, sorted, are cut by range.  A shard is a sequence of parentheses with the excess
  in blocks under a tree of block minima: ``findclose`` delimits a node's subtree, the rank of ``()`` pairs counts its leaves, a
  cumulative array in preorder gives what it saves.
* Spines.  Neighbouring shards of a task share the path between them; its chains count in the first.  The first path of every task goes into a
  trie of all first paths (a row a task), where what the task before has on its last path does not count again.  The values of
  a chain are then added up.

Cases: rows with a null conversation are left out; a null turn comes first; equal turns are ordered by the MD5 of
role and text; null role or text is empty; repeated rows are turns of their own; texts of any length count whole; a conversation may have no turns; an empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import written
from tarmac.llm.resample import duckdb_crc32
from tarmac.llm.runs import running, segments

#: Path elements in a shard at most (and one path more).
SHARD = 1 << 18
#: Ids in a piece of a node's list of ends.
ENDS = 1 << 14
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "h1", "h2"]


class Parentheses:
    """A balanced sequence (1 opens) with excess blocks, a tree of their minima, and ranks."""

    BLOCK = 64

    def __init__(self, bits: np.ndarray):
        self.bits = bits.astype(bool)
        self.opens = np.flatnonzero(self.bits)
        self.excess = np.cumsum(np.where(self.bits, 1, -1))
        n = len(bits)
        blocks = max(1, -(-n // self.BLOCK))
        self.size = 1 << (blocks - 1).bit_length()
        padded = np.full(self.size * self.BLOCK, n + 1, np.int64)
        padded[:n] = self.excess
        self.least = np.empty(2 * self.size, np.int64)
        self.least[self.size:] = padded.reshape(self.size, self.BLOCK).min(1)
        for level in range(self.size.bit_length() - 2, -1, -1):
            at = 1 << level
            self.least[at:2 * at] = self.least[2 * at:4 * at].reshape(-1, 2).min(1)
        self.padded = padded
        # Pairs that start before a position.
        self.pairs = np.append(0, np.cumsum(np.append(self.bits[:-1] & ~self.bits[1:], False)))

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first position from ``at`` to the end of its block whose excess is ``target``; -1 if none."""
        found, step, end = np.full(len(at), -1), at.copy(), (at // self.BLOCK + 1) * self.BLOCK
        live = np.arange(len(at))
        while len(live):
            hit = self.padded[step[live]] == target[live]
            found[live[hit]] = step[live[hit]]
            live = live[~hit]
            step[live] += 1
            live = live[step[live] < end[live]]
        return found

    def findclose(self, i: np.ndarray) -> np.ndarray:
        """The closing position of each opening one."""
        target = self.excess[i] - 1
        out = np.full(len(i), -1)
        near = np.flatnonzero((i + 1) % self.BLOCK)  # the rest of the block of the opening one
        out[near] = self._scan(i[near] + 1, target[near])
        far = np.flatnonzero(out < 0)
        if not len(far):
            return out
        want, node = target[far], i[far] // self.BLOCK + self.size
        climbing = np.ones(len(far), bool)
        while climbing.any():  # up to the first subtree on the right that holds the close
            k = np.flatnonzero(climbing)
            right = (node[k] % 2 == 0) & (self.least[np.minimum(node[k] + 1, len(self.least) - 1)] <= want[k])
            node[k] = np.where(right, node[k] + 1, node[k] // 2)
            climbing[k[right]] = False
        while (node < self.size).any():  # and down to its first block
            k = np.flatnonzero(node < self.size)
            node[k] = 2 * node[k] + (self.least[2 * node[k]] > want[k])
        out[far] = self._scan((node - self.size) * self.BLOCK, want)
        return out

    def leaves(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Leaf pairs from ``i`` to ``j``."""
        return self.pairs[j] - self.pairs[i]


def trie_values(paths: list[list[tuple]], weights: list[list[int]]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Nodes of the trie of sorted ``paths`` in preorder, their leaves, and the weights summed over their subtrees.

    No path starts another.  ``weights`` are those of the elements; of elements that paths share the first counts.
    """
    bits, nodes, own = [], [], []
    before: list[tuple] = []
    for path, w in zip(paths, weights):
        common = 0
        for a, b in zip(path, before):
            if a != b:
                break
            common += 1
        bits += [0] * (len(before) - common) + [1] * (len(path) - common)
        nodes += path[common:]
        own += w[common:]
        before = path
    bits += [0] * len(before)
    p = Parentheses(np.array(bits, np.uint8))
    close = p.findclose(p.opens)
    total = np.append(0, np.cumsum(np.array(own, np.int64)))
    first = np.arange(len(nodes))
    return nodes, p.leaves(p.opens, close), total[first + (close - p.opens + 1) // 2] - total[first]


def _elements(b: pa.RecordBatch) -> Iterator[tuple[list[tuple], list[int]]]:
    for path in b.column("path").to_pylist():
        yield [(x["conv_id"], x["n"]) for x in path], [x["own"] for x in path]


_VALUES = "conv_id long, n long, leaves long, saved long, edge array<struct<bottom:long,conv_id:long,n:long,own:long>>"


def _common(path: list, before: list) -> int:
    return next((k for k, (x, y) in enumerate(zip(path, before)) if x != y), min(len(path), len(before)))


def shard_values(paths: DataFrame, size: int | None = None) -> DataFrame:
    """``conv_id, n, leaves, saved`` of every chain on the ``path`` column's paths (no path starts another)."""
    size = size or SHARD
    names = ["conv_id", "n", "leaves", "saved", "edge"]
    kind = pa.list_(pa.struct([("bottom", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64()), ("own", pa.int64())]))

    def rows(held: list, weights: list) -> pa.RecordBatch:
        nodes, leaves, saved = trie_values(held, weights)
        return pa.record_batch([pa.array([c for c, _ in nodes], pa.int64()), pa.array([n for _, n in nodes], pa.int64()), pa.array(leaves),
                                pa.array(saved), pa.nulls(len(nodes), kind)], names)

    def edge(b: pa.RecordBatch, row: int) -> pa.RecordBatch:
        """The first or last path of a task; ``leaves`` tells which."""
        none = pa.nulls(1, pa.int64())
        return pa.record_batch([none, none, pa.array([min(row, 1)], pa.int64()), none, b.column("path").slice(max(row - 1, 0), 1).cast(kind)], names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weights, n, before, end = [], [], 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            if before is None:  # the first path of a task counts in the trie of first paths
                yield edge(b, 0)
            for path, w in _elements(b):
                if before is None:
                    w = [0] * len(w)
                elif not held:  # counted in the shard before
                    common = _common(path, before)
                    w = [0] * common + w[common:]
                held.append(path)
                weights.append(w)
                before, n = path, n + len(path)
                if n >= size:
                    yield rows(held, weights)
                    held, weights, n = [], [], 0
            end = edge(b, b.num_rows)
        if held:
            yield rows(held, weights)
        if end is not None:
            yield end

    def spine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = sorted(([(x["bottom"], x["conv_id"], x["n"], x["own"]) for x in path], last) for b in batches
                       for path, last in zip(b.column("edge").to_pylist(), b.column("leaves").to_pylist()))
        firsts, weights, before = [], [], []
        for path, last in edges:
            if not last:  # what the task before has on its last path counts there, or with an earlier first path
                common = _common(path, before)
                firsts.append([x[1:3] for x in path])
                weights.append([0] * common + [x[3] for x in path[common:]])
            before = path
        if firsts:
            out = rows(firsts, weights)
            yield out.set_column(2, "leaves", pa.array(np.zeros(out.num_rows, np.int64)))

    ordered = paths.select("path").repartitionByRange("path").sortWithinPartitions("path")
    local = written(ordered.mapInArrow(build, _VALUES), "trie-shards")
    shared = local.where("edge IS NOT NULL").select("leaves", "edge").coalesce(1).mapInArrow(spine, _VALUES)
    return local.where("edge IS NULL").unionByName(shared).groupBy("conv_id", "n").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, h1, h2, ends_sha256``: SHA-256 of the ascending ids (``conv``) that end at a node, joined by commas.

    Ids are joined in pieces where they lie after a sort; a digest reads its pieces one after the other.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy() for c in (*KEY, "conv")]
            new = np.zeros(b.num_rows, bool)
            for c in cols[:3]:
                new[segments(c)] = True
            cut = np.flatnonzero(new | (np.arange(b.num_rows) % ENDS == 0))
            ids = cols[3].astype(str).tolist()
            pieces = [",".join(ids[s:e]) for s, e in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows])]
            yield pa.record_batch([*(pa.array(c[cut]) for c in cols), pa.array(pieces)], [*KEY, "first", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            out = []
            for *k, piece in zip(*(b.column(c).to_pylist() for c in (*KEY, "piece"))):
                if k != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64() if i < 3 else pa.string()) for i in range(4)], [*KEY, "ends_sha256"])
        if key:
            yield pa.record_batch([pa.array([x]) for x in (*key, sha.hexdigest())], [*KEY, "ends_sha256"])

    pieces = ends.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv").mapInArrow(
        join, "depth long, h1 long, h2 long, first long, piece string")
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(parts, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(
        digest, "depth long, h1 long, h2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """A row per node of the trie: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``.

    ``turns``: ``conv, place, digest, chars``, the places of a conversation from 1 without gaps; ``members``: ``conv``, every
    conversation once, also those without turns.
    """
    x1, x2 = F.xxhash64("place", "digest"), F.xxhash64(F.lit(1), "place", "digest")
    rows = running(turns.select("conv", F.col("place").cast("long").alias("depth"), F.col("chars").cast("long").alias("chars"),
                                F.col("chars").cast("long").alias("total"), x1.alias("h1"), x2.alias("h2"), x1.alias("x1"), x2.alias("x2")),
                   "conv", [F.asc("depth")], add=("total",), xor=("h1", "h2"), count="_n").drop("_n")
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n")).where("conv_id IS NOT NULL").select(
        zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv_id", "n", zero.alias("chars"), zero.alias("total"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars"), F.max("total").alias("total"),
        F.max("x1").alias("x1"), F.max("x2").alias("x2")).select(
        *KEY, "conv_id", "n", "chars", "total", F.col("h1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("p2"))
    nodes = written(nodes.unionByName(root), "trie-nodes")

    chains = nodes.groupBy("conv_id", "n").agg(
        F.min(F.struct("depth", "p1", "p2", (F.col("total") - F.col("chars")).alias("before"))).alias("top"),
        F.max(F.struct("depth", "h1", "h2", "total")).alias("end"))
    chains = written(chains.select(
        "conv_id", "n", F.col("top.depth").alias("top"), (F.col("top.depth") - 1).alias("up"), "top.p1", "top.p2", "top.before",
        F.col("end.depth").alias("bottom"), "end.h1", "end.h2", ((F.col("n") - 1) * (F.col("end.total") - F.col("top.before"))).alias("own")), "trie-chains")
    # A chain hangs on the last node of the one above: that node has members that the chain has not.
    above = chains.select(F.col("bottom").alias("up"), F.col("h1").alias("p1"), F.col("h2").alias("p2"),
                          F.col("conv_id").alias("parent"), F.col("n").alias("parent_n"))
    chains = written(chains.join(above, ["up", "p1", "p2"], "left").drop("up", "p1", "p2"), "trie-chains")
    kids = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("parent_n").alias("n")).agg(F.count(F.lit(1)).alias("kids"))
    chains = written(chains.join(kids, ["conv_id", "n"], "left").withColumn("kids", F.coalesce("kids", zero)), "trie-chains")
    below = chains.where("top > 0")

    leaf = below.where("kids = 0").select(F.col("conv_id").alias("conv"))
    on_path = rows.select("conv", *KEY).join(leaf, "conv").join(
        below.select(F.col("bottom").alias("depth"), "h1", "h2", "conv_id", "n", "own"), KEY)
    paths = on_path.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("depth").alias("bottom"), "conv_id", "n", "own"))).alias("path"))
    values = shard_values(paths)
    leaves, saved = chains.agg(F.count_if(F.col("kids") == 0), F.sum("own")).first()  # of the root: two numbers
    values = values.unionByName(chains.where("top = 0").select("conv_id", "n", F.lit(leaves).cast("long").alias("leaves"), F.lit(saved).cast("long").alias("saved")))
    chains = written(chains.join(values, ["conv_id", "n"]).select("conv_id", "n", "top", "before", "bottom", "parent", "kids", "leaves", "saved"), "trie-values")

    last = rows.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("k")).select("conv", "k.*")
    turnless = members.select("conv").join(last, "conv", "left_anti").select("conv", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"))
    ends = end_digests(last.unionByName(turnless))
    return nodes.join(chains, ["conv_id", "n"]).join(ends, KEY, "left").select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(F.col("depth") == F.col("bottom"), F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("total") - F.col("chars") - F.col("before"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv, place, digest, chars`` of a table of ``conv_id, turn, role, text``: places from 1 in the order of the turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"), F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row"))
    return running(rows, "conv", [F.asc_nulls_first("turn"), F.asc("digest"), F.asc("row")]).select("conv", "place", "digest", "chars")


def forked(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations, ``(turns, members)`` as :func:`prefix_trie` takes them.

    Conversation c takes the first h turns of conversation c - c % ``group`` and its own turns after its first h, where h is the CRC-32 of
    c in decimal modulo ``most``.
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumns({
        "base": F.col("conv") - F.col("conv") % group, "h": F.crc32(F.col("conv").cast("string").cast("binary")) % most})
    heads = turns.where((F.col("conv") % group == 0) & (F.col("place") < most)).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))
    convs = written(convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
                    .withColumn("k", F.size("head")), "trie-forks")
    taken = convs.select("conv", F.explode("head").alias("t")).select("conv", "t.*")
    own = turns.join(convs.select("conv", "h", "k"), "conv").where("place > h").select(
        "conv", (F.col("place") - F.col("h") + F.col("k")).alias("place"), "digest", "chars")
    return taken.unionByName(own), convs.select("conv")


def forked_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table."""
    return prefix_trie(*forked(turn_rows(conversations)))


SQL = f"""
WITH o AS (
  SELECT conv_id, r, t, md5(length(r) || ':' || r || t) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || t)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id AS c, max(p) AS n, conv_id - conv_id % 100 AS base FROM o GROUP BY conv_id),
h AS (SELECT *, {duckdb_crc32("c::VARCHAR")} % 6 AS h FROM own),
k AS (SELECT h.c, h.n, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS k FROM h LEFT JOIN own b ON b.c = h.base),
turn AS (
  SELECT k.c, o.p AS d, g, length(t) AS len FROM k JOIN o ON o.conv_id = k.base AND o.p <= k.k
  UNION ALL SELECT k.c, o.p - k.h + k.k, g, length(t) FROM k JOIN o ON o.conv_id = k.c AND o.p > k.h),
member AS (
  SELECT c, d, len, string_agg(g, ',') OVER (PARTITION BY c ORDER BY d) AS key FROM turn
  UNION ALL SELECT c, 0, 0, '' FROM k),
node AS (SELECT d, key, min(c) AS m, count(*) AS n, any_value(len) AS len FROM member GROUP BY d, key),
tied AS (SELECT node.*, pm.key AS up FROM node LEFT JOIN member pm ON pm.c = node.m AND pm.d = node.d - 1),
parent AS (SELECT tied.d, tied.key, tied.m, tied.n, tied.len, tied.up, p.m AS pm FROM tied LEFT JOIN node p ON p.d = tied.d - 1 AND p.key = tied.up),
kids AS (SELECT d - 1 AS d, up AS key, count(*) AS kids FROM tied WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT parent.*, coalesce(kids, 0) AS kids FROM parent LEFT JOIN kids USING (d, key)),
under AS (
  SELECT a.d, a.key, sum(CASE WHEN b.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.len) AS saved
  FROM full_node b JOIN member a ON a.c = b.m AND a.d <= b.d GROUP BY a.d, a.key),
last AS (SELECT c, max(d) AS d FROM member GROUP BY c),
ends AS (SELECT member.d, member.key, sha256(string_agg(member.c::VARCHAR, ',' ORDER BY member.c)) AS e FROM member JOIN last USING (c, d) GROUP BY ALL)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, pm AS parent_conv_id, n AS n_convs, CAST(kids AS BIGINT) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e, sha256('')) AS ends_sha256
FROM full_node JOIN under USING (d, key) LEFT JOIN ends USING (d, key)
"""
