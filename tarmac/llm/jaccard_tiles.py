"""Exact n-gram Jaccard join over size-banded tiles with hashed bitmaps (operator 10).

A document is the set of its distinct word shingles, as 64-bit hashes.  Equal sets are one class from the start.
Classes of similarity ``percent`` or more are found exactly:

* Keys.  With one order of all shingles, rarest first, two sets that similar share a shingle among the first
  ``n - ceil(n * percent / 100) + 1`` of each.  The order is by a count sketch of fixed size over all
  documents, so a passage that a third of the documents share is nobody's key.
* Tiles.  The classes under one key, sorted by size, are cut where sizes are too far apart to link, then
  into blocks of one bitmap width (a size band).  A tile is a pair of blocks of near sizes.
  Keys with the same classes are one tile, whichever key brought them together.  Two similar sets of like size
  share many keys, not one (see ``least_keys``); two classes that are alone under too few keys make no tile.
* Bitmaps.  A set's shingles are hashed to ``4n`` bits or more.  Bits that differ are a lower bound on the
  shingles that differ, so they bound the overlap from above; pairs below the threshold are done.
* Exact.  What is left is intersected as sorted arrays, made again from the texts of the classes in question.

Rounds keep large groups of near copies from being compared pair by pair.  The first takes every class in its largest
tile only, neighbouring blocks and the likeliest pairs; its links are joined to components.  Tiles within one component are
dropped then, on narrow rows, before bitmaps are joined.  The second round takes all other tiles and neighbouring blocks, the third adds the
blocks further apart.  In a round each component of a tile takes its likeliest pairs with others (in order of the bound), since one
link joins it whole; a tile with pairs left goes on with sixteen times as many for each component while it holds classes of different
components.  Nothing is capped: every pair that the bitmaps let through is intersected or already connected.

Cases: a null or empty text, or one without words, has no shingles and links with nothing; a text of fewer than
``k`` words is one shingle; a null id has its count, no links and a null component; repeated rows share a class; an empty
table gives no rows.  Columns beyond the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small, written
from tarmac.llm.components import BROADCAST_IDS, components, document_components, few

#: Counters of the shingle sketch; 32 bits each.
SKETCH = 1 << 17
#: Classes in a block of a tile.
BLOCK = 512
MIN_BITS, MAX_BITS = 256, 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHash(dict):
    """Memo of word hashes (8 bytes each), cleared when large."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_digest(word)
        return h


_WORDS = _WordHash()


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _MIX
    return a ^ (a >> np.uint64(29))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles of a text (A-Z lower-cased, ASCII white space)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(_WORDS.__getitem__, words)), ">u8").astype(np.uint64)
    n = max(1, len(h) - k + 1)
    a = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        a = _mix(a + h[j:j + n])
    a.sort()
    return a[np.concatenate([[True], a[1:] != a[:-1]])]


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit id of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def prefix_size(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def least_keys(na: int, nb: int, percent: int) -> int:
    """Keys that two sets of these sizes share at least if they are ``percent`` similar.

    With an overlap of ``o`` or more, the i-th shared shingle is at place ``i + na - o`` or before in one set's
    order and ``i + nb - o`` or before in the other's, so it is a key of both up to some i.
    """
    o = -(-percent * (na + nb) // (100 + percent))
    return max(1, min(prefix_size(na, percent) - na + o, prefix_size(nb, percent) - nb + o))


def bits_for(n: int) -> int:
    """Bitmap width of a set of ``n``: a power of two, four times ``n`` or up to eight times."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (4 * n - 1).bit_length()))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(bits_for(len(s)), np.uint8)
    bits[(s >> np.uint64(20)) & np.uint64(len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) folded to fewer words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def close_pairs(na: np.ndarray, ma: np.ndarray, nb: np.ndarray, mb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row indices of pairs whose bitmaps allow the similarity, and the bound on their overlap over the size."""
    width = min(ma.shape[1], mb.shape[1])
    ma, mb = fold(ma, width), fold(mb, width)
    left, right, bound = [], [], []
    for i in range(len(na)):
        total = nb + na[i]
        top = (total - np.bitwise_count(mb ^ ma[i]).sum(1, dtype=np.int64)) // 2
        top = np.minimum(top, np.minimum(nb, na[i]))
        j = np.flatnonzero(100 * top >= percent * (total - top))
        left.append(np.full(len(j), i))
        right.append(j)
        bound.append(top[j] / np.maximum(total[j] - top[j], 1))
    return np.concatenate(left), np.concatenate(right), np.concatenate(bound)


def best_of_each(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Marks of the pairs (of components ``a, b``, the likeliest first) that are among the first ``most`` of either component."""
    ends = np.concatenate([a, b])
    order = np.lexsort((np.tile(np.arange(len(a)), 2), ends))
    first = np.flatnonzero(np.diff(ends[order], prepend=ends[order[:1]] - 1) != 0)
    place = np.empty(len(ends), np.int64)
    place[order] = np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends))))
    return (place < most).reshape(2, -1).any(0)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: two sorted sets are at least ``percent`` similar."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``id, n, sid, bits`` of every document, and a row with a ``sketch`` for every task."""
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SKETCH, np.int64), set()
        names = ["id", "n", "sid", "bits", "sketch"]
        for b in small(batches):
            ids, n, sid, bits = b.column("id").to_pylist(), [], [], []
            for i, t in zip(ids, b.column("text").to_pylist()):
                s = shingles(t, k)
                n.append(len(s))
                live = len(s) and i is not None
                sid.append(set_id(s) if live else None)
                first = live and sid[-1] not in seen
                if first:
                    seen.add(sid[-1])
                    np.add.at(counts, (s & np.uint64(SKETCH - 1)).astype(np.int64), 1)
                bits.append(bitmap(s) if first else None)
            yield pa.record_batch([b.column("id"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()),
                                   pa.array(bits, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        yield pa.record_batch([pa.nulls(1, pa.int64()), pa.array([-1], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
                               pa.array([np.minimum(counts, 2 ** 32 - 1).astype(np.uint32).tobytes()], pa.binary())], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(measure, "id long, n long, sid long, bits binary, sketch binary"), "jt-signatures")


def sketch_of(signs: DataFrame) -> np.ndarray:
    """The sketches of all tasks added up: a few partial sums of fixed size reach the driver."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for x in b.column("sketch"):
                total += np.frombuffer(x.as_py(), np.uint32)
        yield pa.record_batch({"sketch": pa.array([total.tobytes()], pa.binary())})

    parts = signs.where("sketch IS NOT NULL").select("sketch").repartition(8).mapInArrow(add, "sketch binary").collect()
    return sum((np.frombuffer(bytes(r["sketch"]), np.int64) for r in parts), np.zeros(SKETCH, np.int64))


def smallest(order: np.ndarray, s: np.ndarray, size: int) -> np.ndarray:
    """Places of the ``size`` smallest by (order, s)."""
    if size >= len(s):
        return np.arange(len(s))
    at = np.argpartition(order, size)
    if (order == order[at[:size]].max()).sum() > 1:  # a tie at the cut
        return np.lexsort((s, order))[:size]
    return at[:size]


def prefix_rows(docs: DataFrame, counts, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``key, sid, n``: every set under its rarest shingles; equal sets of a task once."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        rank = counts.value
        for b in small(batches):
            out, sids, ns = [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, k)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                order = (rank[(s & np.uint64(SKETCH - 1)).astype(np.int64)] << np.uint64(44)) | (s >> np.uint64(20))
                out.append(s[smallest(order, s, prefix_size(len(s), percent))])
                sids.append(sid)
                ns.append(len(s))
            if out:
                lens = list(map(len, out))
                yield pa.record_batch({"key": pa.array(np.concatenate(out).view(np.int64)),
                                       "sid": pa.array(np.repeat(np.array(sids, np.int64), lens)),
                                       "n": pa.array(np.repeat(np.array(ns, np.int64), lens))})

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    return rows.mapInArrow(keys, "key long, sid long, n long")


def tile_members(keyed: DataFrame, percent: int) -> DataFrame:
    """``tile, sid, n, block, low, high``: the classes that share a key, by block; each set of classes once.

    ``low`` to ``high`` are the blocks of the tile whose sizes can link with the row's block.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(), b.column("sid").to_numpy(), b.column("n").to_numpy()) for b in batches]
        if not got:
            return
        key, sid, n = (np.concatenate(x) for x in zip(*got))
        del got
        order = np.lexsort((sid, n, key))
        key, sid, n = key[order], sid[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid, n = key[new], sid[new], n[new]
        start = np.ones(len(key), bool)
        start[1:] = (key[1:] != key[:-1]) | (100 * n[:-1] < percent * n[1:])
        first = np.flatnonzero(start)
        size = np.diff(np.append(first, len(key)))
        tile = np.add.reduceat(_mix(sid.view(np.uint64) + np.uint64(1)), first).view(np.int64)
        _, once, times = np.unique(np.where(size > 1, tile, 0), return_index=True, return_counts=True)
        times = dict(zip(once.tolist(), times.tolist()))
        once = once[size[once] > 1]
        names = ["tile", "sid", "n", "block", "low", "high", "least", "keys"]
        held: list[list[np.ndarray]] = []
        rows = 0
        for g in once.tolist():
            a, m = int(first[g]), int(size[g])
            own = n[a:a + m]
            if m <= BLOCK and bits_for(int(own[0])) == bits_for(int(own[-1])):
                block = low = high = np.zeros(m, np.int32)
            else:
                width = np.array([bits_for(int(x)) for x in own])
                turn = np.flatnonzero(np.diff(width, prepend=-1))
                since = np.arange(m) - np.repeat(turn, np.diff(np.append(turn, m)))
                block = (np.cumsum(since % BLOCK == 0) - 1).astype(np.int32)
                edge = np.flatnonzero(np.diff(block, prepend=-1))
                least, most = own[edge], own[np.append(edge[1:], m) - 1]
                low = np.searchsorted(100 * most, percent * least).astype(np.int32)[block]
                high = (np.searchsorted(percent * least, 100 * most, side="right") - 1).astype(np.int32)[block]
            least_of = least_keys(int(own[0]), int(own[1]), percent) if m == 2 else 0
            held.append([np.full(m, tile[g]), sid[a:a + m], own, block, low, high, np.full(m, least_of), np.full(m, times[g])])
            rows += m
            if rows > 100_000 or g == once[-1]:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                held, rows = [], 0
        if held:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    spark = keyed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed.repartition(parts, "key").mapInArrow(
        cut, "tile long, sid long, n long, block int, low int, high int, least long, keys long")
    # A pair that is alone under some keys and with others under more is compared in the larger tile.
    kept = rows.groupBy("tile", "sid", "n", "block", "low", "high", "least").agg(F.sum("keys").alias("keys")).where("keys >= least")
    return written(kept.drop("least", "keys"), "jt-tiles")


def candidate_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of this round's pairs; rows with ``more`` name a tile (``tile, i, j, turn``) with pairs left.

    ``tiles`` has ``tile, i, j, turn, block, sid, n, bits, comp``.  Of the pairs of different components, each component of a tile
    takes its likeliest: 2 in ``turn`` -1 (the tile comes again) and 0, sixteen times more in each turn after that.  So a turn's pairs
    are in proportion to a tile's components, not to their square; a tile is done when its components have taken all.
    """
    names = ["a", "b", "more", "tile", "i", "j", "turn"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        tile, i, j, turn, block, sid, n, comp = (
            t.column(c).to_numpy() for c in ("tile", "i", "j", "turn", "block", "sid", "n", "comp"))
        bits = t.column("bits").combine_chunks()
        order = np.lexsort((sid, n, block, j, i, tile))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(tile[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        edges = np.append(np.flatnonzero(new), len(order))
        a_out: list[np.ndarray] = []
        b_out: list[np.ndarray] = []
        left_over: list[int] = []
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            rows = order[s:e]
            left = rows[block[rows] == i[rows[0]]]
            right = rows[block[rows] == j[rows[0]]]
            if not len(left) or not len(right) or comp[rows].min() == comp[rows].max():
                continue
            maps = [np.frombuffer(b"".join(x.as_py() for x in bits.take(pa.array(side))), np.uint64).reshape(len(side), -1)
                    for side in (left, right)]
            x, y, bound = close_pairs(n[left], maps[0], n[right], maps[1], percent)
            if i[rows[0]] == j[rows[0]]:
                keep = x < y
                x, y, bound = x[keep], y[keep], bound[keep]
            x, y = left[x], right[y]
            apart = comp[x] != comp[y]
            x, y, bound = x[apart], y[apart], bound[apart]
            likeliest = np.lexsort((np.maximum(sid[x], sid[y]), np.minimum(sid[x], sid[y]), -bound))
            x, y = x[likeliest], y[likeliest]
            took = int(turn[rows[0]])
            keep = best_of_each(comp[x], comp[y], 2 * 16 ** max(took, 0))
            if took >= 0 and not keep.all():
                left_over.append(rows[0])
            a_out.append(sid[x[keep]])
            b_out.append(sid[y[keep]])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_out, b_out))
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)  # two classes meet in many tiles
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        none = [pa.nulls(len(a), t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int32())]
        yield pa.record_batch([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), bool)), *none], names)
        if left_over:
            k = np.array(left_over)
            yield pa.record_batch([pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(np.ones(len(k), bool)),
                                   pa.array(tile[k]), pa.array(i[k]), pa.array(j[k]), pa.array(turn[k] + 1, pa.int32())], names)

    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = tiles.repartition(parts, "tile", "i", "j").mapInArrow(
        compare, "a long, b long, more boolean, tile long, i int, j int, turn int")
    return written(pairs.distinct(), "jt-pairs")


def fetch_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """``sid, s``: the sorted shingles of the classes ``wanted`` (``sid, id``), made from the texts of their first documents.

    The ids go to the texts while there are few of them (counted), else both sides are shuffled.
    """
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sid, out = [], []
            for want, t in zip(b.column("sid").to_pylist(), b.column("text").to_pylist()):
                s = shingles(t, k)
                if len(s) and set_id(s) == want:  # a repeated id may have another text
                    sid.append(want)
                    out.append(s.tobytes())
            yield pa.record_batch({"sid": pa.array(sid, pa.int64()), "s": pa.array(out, pa.binary())})

    wanted = written(wanted, "jt-wanted")
    n = wanted.count()
    wanted = F.broadcast(wanted) if n <= BROADCAST_IDS else wanted
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id").select("sid", "text")
    sets = written(texts.mapInArrow(arrays, "sid long, s binary"), "jt-sets")
    # Only rows that repeat an id make a class twice.
    return sets if sets.count() <= n else written(sets.dropDuplicates(["sid"]), "jt-sets")


def verified_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` that are as similar as asked, by exact intersection."""
    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            hit = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                   for x, y in zip(b.column("x"), b.column("y"))]
            yield pa.record_batch([b.column("a"), b.column("b")], ["u", "v"]).filter(pa.array(hit, pa.bool_()))

    few = pairs.count() <= BROADCAST_IDS
    left = F.broadcast(pairs) if few else pairs
    right = pairs.select("b").distinct()
    both = sets.select(F.col("sid").alias("a"), F.col("s").alias("x")).join(left, "a") \
        .join(sets.select(F.col("sid").alias("b"), F.col("s").alias("y")).join(F.broadcast(right) if few else right, "b", "left_semi"), "b") \
        .select("a", "b", "x", "y")
    return written(both.mapInArrow(intersect, "u long, v long"), "jt-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                       percent: int = 80) -> DataFrame:
    """A row per document: id, ``n_shingles``, ``component_id`` (the smallest id that links reach)."""
    spark = docs.sparkSession
    signs = signatures(docs, id_col, text_col, k)
    every = signs.where("n >= 0").select("id", "n", "sid")
    counts = np.minimum(sketch_of(signs), (1 << 20) - 1).astype(np.uint64)
    tiles = tile_members(prefix_rows(docs, spark.sparkContext.broadcast(counts), id_col, text_col, k, percent), percent)
    first_doc = every.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("id"))
    bits = written(signs.where("bits IS NOT NULL").select("sid", "bits").dropDuplicates(["sid"]), "jt-bits")
    pair = [F.least("block", "peer").alias("i"), F.greatest("block", "peer").alias("j")]

    def near(rows: DataFrame, turn: int) -> DataFrame:
        """Tiles of blocks beside each other."""
        return rows.withColumn("peer", F.explode(F.sequence(F.greatest("low", F.col("block") - 1), F.least("high", F.col("block") + 1)))) \
            .select("*", *pair, F.lit(turn).alias("turn")).drop("peer")

    def with_components(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows.withColumn("comp", F.col("sid"))
        return rows.join(few(roots.withColumnRenamed("node", "sid")), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root")

    links = tried = roots = sets = None
    # Every class in its largest tile.
    sizes = few(written(tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("rows")), "jt-sizes"))
    largest = tiles.select("tile", "sid").join(sizes, "tile").groupBy("sid").agg(F.max(F.struct("rows", "tile")).alias("t")).select("sid", "t.tile")
    rows = near(tiles.join(largest, ["sid", "tile"]).join(bits, "sid"), -1)
    members, turn = None, -1
    while True:
        found = candidate_pairs(with_components(rows).select("tile", "i", "j", "turn", "block", "sid", "n", "bits", "comp"), percent)
        pairs = found.where("NOT more").select("a", "b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "jt-todo")
        if not pairs.isEmpty():
            wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("sid"), "sid", "left_anti")
            more_sets = fetch_sets(docs, wanted.join(first_doc, "sid"), id_col, text_col, k)
            sets = more_sets if sets is None else sets.unionByName(more_sets)
            fresh = verified_links(pairs, sets, percent)
            tried = pairs if tried is None else tried.unionByName(pairs)
            if not fresh.isEmpty():
                links = fresh if links is None else links.unionByName(fresh)
                roots = components(links)
        turn += 1
        if turn == 0:
            live = with_components(tiles.select("tile", "sid")).groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("tile")
            members = written(tiles.join(few(written(live, "jt-live")), "tile", "left_semi").join(bits, "sid"), "jt-members")
            rows = near(members, 0)
        else:
            left = found.where("more").select("tile", "i", "j", "turn")
            rows = members.join(few(left), "tile").where("block = i OR block = j")
            if turn == 1:  # the blocks further apart
                rows = rows.unionByName(members.where("low < block - 1 OR high > block + 1").withColumn("peer", F.explode(F.sequence("low", "high")))
                                        .where("abs(peer - block) > 1").select("*", *pair, F.lit(0).alias("turn")).drop("peer"))
        if rows.isEmpty():
            break
    return document_components(every, first_doc, roots).withColumnsRenamed({"id": id_col, "n": "n_shingles"})


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the smallest id of every component, with all their columns.

    An id stands for one document: rows of an id stay or go together, and of rows equal in id and text one
    stays.  Rows with a null id stay.
    """
    found = jaccard_components(docs, id_col, text_col, k, percent)
    ids = written(found.groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col("component_id") < F.col(id_col)).alias("gone"), F.count(F.lit(1)).alias("copies")).where(
        F.col("_id").isNotNull() & (F.col("gone") | (F.col("copies") > 1))), "jt-gone")
    gone = ids.where("gone").select("_id")
    if ids.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
    again = ids.where("NOT gone AND copies > 1")
    if again.isEmpty():
        return kept
    again = again.select(F.col("_id").alias("_again"))
    twice = kept.join(again, kept[id_col] == again["_again"], "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, kept[id_col] == again["_again"], "left_anti").unionByName(twice)
