"""Near copies by an LSH forest of MinHash signatures (operator 12).

A document is the set of its distinct word shingles; equal sets are one class.  A class has ``TREES`` times ``DEPTH`` minimal
hashes.  A tree of the forest is one sorted order of the classes by ``DEPTH`` of them: the rows of an order that
share the longest prefixes with a class stand beside it.  A class's candidates in a tree are the rows up to ``reach`` places away that share
a prefix of ``SHALLOWEST`` hashes or more; how deep they share it is up to how crowded the region is: few rows
near a class are taken down to the shallowest depth, in a region of near copies those that agree longest come first.  Candidates
whose hashes of the tree agree in less than half of the places are left out (of 12, a pair at 85 of 100 agrees in fewer than 6 once
in 3,000 trees).  Every other candidate is intersected exactly on the full sets.

Rounds take more trees and a longer reach each; links are joined to components after each, and pairs within a component are no longer
candidates, so a group of n near copies gives a multiple of n pairs.  Reach is no cap: the regions that are longer than it and hold
several components go on with a 64 times longer reach until there is none.  They are taken ``DEEPER`` (equal first three hashes), and twice:
``alike_rows`` keeps the rows that have a row of another component beside them whose whole signature (a byte a hash) agrees in 76 of 100 places
or more (three standard deviations below 85); ``region_links`` takes these rows with their sets, intersects a pair at once, in the
first tree where it shares a region, if the links found in the cell do not connect it yet, and gives a link only where it joins two components.  So
neither step makes more rows than it gets, however many pairs of a region lie about the threshold.
Rows are numbered along each order (``runs.running``) and compared in cells of ``CELL`` places (four times the reach, if that is more), to which the rows
before within reach are sent too, so neither a cut of the order nor a large region matters.  A task holds the rows within reach.  A pair at the
threshold is missed by one tree with a probability of 0.28 and by all twelve with 2 in 10 million, in long regions of all twelve trees with 1 in
100,000 (test: the exact join of ``jaccard_tiles`` gives the same components).

Cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of fewer than ``k`` words is one
shingle; a null id has its count, a null component and is kept; repeated rows and equal sets share a class; texts of any length are
taken whole; an empty table gives no rows.  Columns beyond the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small, written
from tarmac.llm.components import components, document_components, few
from tarmac.llm.jaccard_tiles import fetch_sets, linked, set_id, shingles, verified_links
from tarmac.llm.runs import running

TREES, DEPTH, SHALLOWEST, DEEPER = 12, 12, 2, 3
#: (trees, places to either side) of each round.
ROUNDS = ((1, 2), (3, 4), (8, 16))
#: Places of an order in a cell.
CELL = 512
#: Hashes of 100 that agree at least in a long region.
ALIKE = 76
_RNG = np.random.default_rng(12)
_A = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def signature(s: np.ndarray, rows: int = 1024) -> np.ndarray:
    """Minimal hashes (32 bits) of a set, a run of ``DEPTH`` for each tree."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), rows):
        least = np.minimum(least, (s[k:k + rows, None] * _A + _B).min(0))
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id, n, sid, sig, low`` of every document; ``sig`` (big-endian, so that bytes sort as hashes) and the last byte of each of its
    hashes, ``low``, once for a class and task."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in small(batches):
            n, sid, sig, low = [], [], [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(t, k)
                n.append(len(s))
                sid.append(set_id(s) if len(s) and i is not None else None)
                first = sid[-1] is not None and sid[-1] not in seen
                if first:
                    seen.add(sid[-1])
                sig.append(signature(s).astype(">u4").tobytes() if first else None)
                low.append(sig[-1][3::4] if first else None)
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(sig, pa.binary()),
                                   pa.array(low, pa.binary())], ["id", "n", "sid", "sig", "low"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(measure, "id long, n long, sid long, sig binary, low binary"), "lf-signatures")


def _in_cells(rows: DataFrame, reach: int) -> DataFrame:
    """``rows`` with their ``place`` in their tree's order, dealt out by ``cell`` with the rows up to ``reach`` places before it; ``home`` in one."""
    size = max(CELL, 4 * reach if reach > CELL else 0)
    placed = running(rows.withColumn("order", F.col("tree").cast("long")), "order", ["hashes", "sid"]).drop("order")
    cells = placed.withColumn("cell", F.explode(F.expr(f"sequence(place div {size}, (place + {reach}) div {size})")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.withColumn("home", F.expr(f"place div {size} = cell")).repartition(parts, "tree", "cell").sortWithinPartitions("tree", "cell", "place")


def _hashes(b: pa.RecordBatch, column: str, kind: str = ">u4") -> np.ndarray:
    return np.frombuffer(b"".join(b.column(column).to_pylist()), kind).reshape(b.num_rows, -1)


def _beside(batches: Iterator[pa.RecordBatch], reach: int, depth: int) -> Iterator[tuple]:
    """``rows, hashes, steps`` of batches with the rows held from before; ``steps`` gives ``i, j``: places of rows that lie a number of steps
    apart in a cell, share ``depth`` hashes and are of two components."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        old = 0 if held is None else held.num_rows
        h = _hashes(b, "hashes")
        tree, comp, cell, home = (b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "comp", "cell", "home"))
        new = (tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1]) | (h[1:, :depth] != h[:-1, :depth]).any(1)
        run = np.append(0, np.cumsum(new))  # regions of a cell are runs of rows

        def steps(n=b.num_rows, old=old, run=run, comp=comp, home=home):
            for w in range(1, min(reach, n - 1) + 1):
                i = np.arange(max(0, old - w), n - w)  # pairs with a new row
                i = i[run[i] == run[i + w]]
                if not len(i) and old < w:
                    break  # no run is that long
                i = i[home[i + w] & (comp[i] != comp[i + w])]
                if len(i):
                    yield i, i + w

        yield b, h, steps()
        held = b.slice(max(0, b.num_rows - reach))


def neighbours(rows: DataFrame, reach: int) -> DataFrame:
    """``a, b``: candidates of every order of ``rows`` (``tree, hashes, sid, comp``)."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, steps in _beside(batches, reach, SHALLOWEST):
            sid, left, right = b.column("sid").to_numpy(), [], []
            for i, j in steps:
                near = 2 * (h[i] == h[j]).sum(1) >= DEPTH
                left.append(sid[i[near]])
                right.append(sid[j[near]])
            if left:
                x, y = np.concatenate(left), np.concatenate(right)
                yield pa.record_batch({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return _in_cells(rows, reach).mapInArrow(walk, "a long, b long").distinct()


def _alike(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs agree in ``ALIKE`` of 100 hashes; some thousand pairs at a time."""
    return np.concatenate([100 * (low[x] == low[y]).sum(1) >= ALIKE * low.shape[1]
                           for x, y in zip(np.array_split(i, 1 + len(i) // 4096), np.array_split(j, 1 + len(j) // 4096))])


def alike_rows(rows: DataFrame, reach: int) -> DataFrame:
    """``tree, sid`` of the ``rows`` (with ``low``) that have a row of another component and a like signature in their region."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, steps in _beside(batches, reach, DEEPER):
            low, hit = _hashes(b, "low", "u1"), np.zeros(b.num_rows, bool)
            for i, j in steps:
                open_ = ~(hit[i] & hit[j])
                i, j = i[open_], j[open_]
                if len(i):
                    near = _alike(low, i, j)
                    hit[i[near]] = hit[j[near]] = True
            yield b.select(["tree", "sid"]).filter(pa.array(hit))

    return _in_cells(rows, reach).mapInArrow(mark, "tree int, sid long").distinct()


def region_links(rows: DataFrame, reach: int, percent: int) -> DataFrame:
    """``u, v``: links of the ``rows`` (with ``sig``, ``low`` and the sorted set ``s``) that join components of a cell; at most one for a row."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[tuple, tuple] = {}  # by tree, cell and component
        at = None

        def find(x: tuple) -> tuple:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for b, _, steps in _beside(batches, reach, DEEPER):
            low, sid, comp, tree, cell = _hashes(b, "low", "u1"), *(b.column(c).to_numpy() for c in ("sid", "comp", "tree", "cell"))
            heads = _hashes(b, "sig").reshape(b.num_rows, TREES, DEPTH)[:, :, :DEEPER]
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("s")]
            u, v = [], []
            for i, j in steps:
                near = _alike(low, i, j)
                i, j = i[near], j[near]
                first = ~((heads[i] == heads[j]).all(2) & (np.arange(TREES) < tree[i][:, None])).any(1)
                for x, y in zip(i[first].tolist(), j[first].tolist()):
                    here = tree[x], cell[x]
                    p, q = find((*here, comp[x])), find((*here, comp[y]))
                    if p != q and linked(sets[x], sets[y], percent):
                        parent[p] = q
                        u.append(sid[x])
                        v.append(sid[y])
            last = int(tree[-1]), int(cell[-1])
            if last != at:
                parent = {k: r for k, r in parent.items() if k[:2] == last}
                at = last
            yield pa.record_batch({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return _in_cells(rows, reach).mapInArrow(verify, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """A row per document: id, ``n_shingles``, ``component_id`` (the smallest id that links reach), ``kept`` (it is that id)."""
    signs = signatures(docs, id_col, text_col, k)
    every = signs.select("id", "n", "sid")
    first_doc = written(every.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("id")), "lf-classes")
    classes = signs.where("sig IS NOT NULL").select("sid", "sig", "low").dropDuplicates(["sid"])
    roots = tried = sets = None

    def with_components(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("comp", F.col("sid"))
        return rows.join(few(roots.withColumnRenamed("node", "sid")), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")

    def in_trees(trees: range, *more: str) -> DataFrame:
        own = [F.struct(F.lit(t).alias("tree"), F.substring("sig", 4 * DEPTH * t + 1, 4 * DEPTH).alias("hashes")) for t in trees]
        return with_components(classes.select("sid", *more, F.explode(F.array(*own)).alias("o")).select("sid", *more, "o.*"))

    def sets_of(sids: DataFrame) -> DataFrame:
        wanted = sids.distinct() if sets is None else sids.distinct().join(sets.select("sid"), "sid", "left_anti")
        got = fetch_sets(docs, wanted.join(first_doc, "sid"), id_col, text_col, k)
        return got if sets is None else sets.unionByName(got)

    def joined(links: DataFrame) -> DataFrame | None:
        """The components so far and the new links."""
        if links.isEmpty():
            return roots
        return components(links if roots is None else links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))

    done = reach = 0
    for trees, reach in ROUNDS:
        pairs = neighbours(in_trees(range(done, done + trees)), reach)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "lf-pairs")
        done += trees
        if not pairs.isEmpty():
            sets = sets_of(pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))))
            roots = joined(verified_links(pairs, sets, percent))
            tried = pairs if tried is None else tried.unionByName(pairs)
    region = F.substring("hashes", 1, 4 * DEEPER).alias("region")
    while True:
        every_region = in_trees(range(done)).select("tree", region, "comp").groupBy("tree", "region").agg(
            F.count(F.lit(1)).alias("rows"), F.min("comp").alias("x"), F.max("comp").alias("y"))
        still = written(every_region.where((F.col("rows") > reach + 1) & (F.col("x") < F.col("y"))).select("tree", "region"), "lf-regions")
        if still.isEmpty():
            break
        reach *= 64
        open_rows = written(in_trees(range(done), "low").select("*", region).join(few(still), ["tree", "region"], "left_semi").drop("region"), "lf-open")
        alike = written(alike_rows(open_rows, reach), "lf-alike")
        if not alike.isEmpty():
            sets = sets_of(alike.select("sid"))
            rows = open_rows.join(few(alike), ["tree", "sid"], "left_semi").join(classes.select("sid", "sig"), "sid").join(sets, "sid")
            roots = joined(written(region_links(rows, reach, percent), "lf-links"))
    found = document_components(every, first_doc, roots)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 85) -> DataFrame:
    """The rows of the documents that are kept, with all their columns; rows that repeat an id stay or go together, a null id stays."""
    gone = near_copies(docs, id_col, text_col, k, percent).groupBy(F.col(id_col).alias("_gone_id")).agg(
        F.max(~F.col("kept")).alias("_gone")).where("_gone").select("_gone_id")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")
