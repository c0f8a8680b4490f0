"""Benchmark decontamination by BM25 with block-max WAND (operator 1).

The test items are indexed: a term's posting list holds the items that have it, with their BM25
impact divided by the item's score against itself, so a passage that holds a whole item scores 1 or nearly
so.  Items are cut into blocks, and each term keeps its largest impact in each block.  Every
training text is cut into overlapping passages, wide enough to hold any item whole; each is a
query.  The block maxima of a passage's terms bound every item's score, so a passage
none of whose blocks can reach the threshold is done; the others run block-max WAND and give
all items above the threshold, without a limit on their number.

A hit is verified on the passage's words: the overlap of the question and of the answer must reach
``min_overlap``.  The answer is what follows the last question mark; an item without one is a single part.
The overlap of a part is the share of its word n-grams found in the passage, or that of its words found in
their order (longest common subsequence) within a stretch of two to three times its length, if that is more: a
changed word breaks every n-gram of a short part, but takes one word from its order.

Items go to the tasks in blocks of ``max_items`` or of a bounded table of maxima (sizes known), with document frequencies
over all items; the corpus is read once for each block.

Cases: a null text has no words and matches nothing; a null item text is no item, a null item id reads -1; repeated items
are items each; a text that repeats is searched each time; an empty benchmark or corpus gives no rows.
Columns beyond ids and texts are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_answer(text: str) -> tuple[str, str]:
    """The two parts of an item; the answer may be empty."""
    head, mark, tail = text.rpartition("?")
    if mark and words_of(tail):
        return head + mark, tail
    parts = re.split(r"(?<=[.!?])\s+", text.strip())
    parts = [p for p in parts if words_of(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


def item_parts(text: str) -> list[list[str]]:
    """The words of each part that is verified: question and answer, or the whole item if no mark splits it."""
    parts = question_answer(text) if "?" in text and words_of(text.rpartition("?")[2]) else (text,)
    return [p for p in map(words_of, parts) if p]


def in_order(part: list[str], words: list[str]) -> int:
    """Length of the longest common subsequence, most over stretches of ``words``: any 2 * len(part) in a row are in one."""
    n = len(part)
    at: dict[str, int] = {}
    for i, w in enumerate(part):
        at[w] = at.get(w, 0) | 1 << i
    hits = [at.get(w, 0) for w in words]
    best, full = 0, (1 << n) - 1
    for lo in range(0, max(1, len(words) - 2 * n + 1), n):
        found = [m for m in hits[lo:lo + 3 * n] if m]
        if len(found) > best:
            row = full
            for m in found:
                # Bit-parallel row of the table: a 0 is a step up.
                u = row & m
                row = ((row + u) | (row - u)) & full
            best = max(best, n - row.bit_count())
    return best


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = max(1, min(n, len(words)))
    return set(zip(*(words[k:] for k in range(n))))


@dataclass
class Item:
    """One test item as it is verified: the words of its parts and their n-grams."""

    item_id: int
    parts: list[tuple[int, list[str], set[tuple[str, ...]]]]


class BlockMaxIndex:
    """Inverted index of items with a maximum impact per term and block of items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_len: float,
                 block: int = 8, n_gram: int = 5):
        bags = [words_of(t) for _, t in items]
        self.items, self.block = [], block
        for (i, t), words in zip(items, bags):
            self.items.append(Item(i, [(min(n_gram, len(p)), p, grams(p, n_gram)) for p in item_parts(t)]))
        self.longest = max(map(len, bags), default=0)
        self.terms: dict[str, int] = {}
        impacts: dict[tuple[int, int], float] = {}
        for d, words in enumerate(bags):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            raw = {}
            for w, f in tf.items():
                idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
                raw[w] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / mean_len))
            own = math.fsum(raw.values())
            for w, x in raw.items():
                impacts[self.terms.setdefault(w, len(self.terms)), d] = x / own
        self.n_blocks = -(-len(items) // block)
        self.maxima = np.zeros((len(self.terms) + 1, max(1, self.n_blocks)), np.float32)
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for (t, d), x in sorted(impacts.items()):
            lists[t].append((d, x))
            # Rounded up, so that the bound never falls below the impact.
            self.maxima[t, d // block] = max(self.maxima[t, d // block], np.nextafter(np.float32(x), np.float32(2)))
        self.postings = [([d for d, _ in p], [x for _, x in p]) for p in lists]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items whose score for distinct ``terms`` reaches the threshold, by block-max WAND."""
        if not terms:
            return []
        bound = self.maxima[terms]
        alive = np.flatnonzero(bound.sum(0) >= threshold - 1e-5)
        if not len(alive):
            return []
        # Only terms of items in the blocks that are left count.
        most = bound[:, alive].max(1)
        used = np.flatnonzero(most)
        terms, top, by_block, alive = [terms[k] for k in used], most[used].tolist(), bound[used].tolist(), alive.tolist()
        next_alive = [alive[bisect_left(alive, b)] * self.block if b <= alive[-1] else len(self.items) for b in range(self.n_blocks + 1)]
        at = [0] * len(terms)
        lists = [self.postings[t] for t in terms]
        end = len(self.items)
        cur = [p[0][0] for p in lists]
        order = list(range(len(terms)))
        hits = []

        def skip(q: int, to: int) -> None:
            docs = lists[q][0]
            at[q] = k = bisect_left(docs, to, at[q])
            cur[q] = docs[k] if k < len(docs) else end

        for q in order:
            if cur[q] < next_alive[0]:
                skip(q, next_alive[0])
        while True:
            order.sort(key=cur.__getitem__)
            total, pivot = 0.0, -1
            for q in order:
                if cur[q] == end:
                    break
                total += top[q]
                if total >= threshold - 1e-5:
                    pivot = cur[q]
                    break
            if pivot < 0:
                return hits
            block = pivot // self.block
            to = next_alive[block]
            if to <= pivot and sum(by_block[q][block] for q in order if cur[q] <= pivot) < threshold - 1e-5:
                # No item of this block up to the next posting can reach the threshold.
                to = min([(block + 1) * self.block, *(cur[q] for q in order if cur[q] > pivot)])
            if to > pivot:
                for q in order:
                    if cur[q] < to:
                        skip(q, to)
                continue
            if cur[order[0]] == pivot:
                score = math.fsum(lists[q][1][at[q]] for q in order if cur[q] == pivot)
                if score >= threshold - 1e-9:
                    hits.append((pivot, score))
                for q in order:
                    if cur[q] == pivot:
                        skip(q, pivot + 1)
            else:
                for q in order:
                    if cur[q] < pivot:
                        skip(q, pivot)

    def candidates(self, words: list[str], threshold: float, run_bytes: int = 1 << 24) -> list[tuple[int, int, float, tuple[int, int]]]:
        """(item, passage, score, word range) of the passages of a text that some item's bound lets through."""
        get, none = self.terms.get, len(self.terms)
        ids = np.fromiter(map(get, words, repeat(none)), np.int64, len(words))
        step = max(64, self.longest)
        places = np.flatnonzero(ids < none)
        if not len(places):
            return []
        # Distinct (half passage, term): a passage is two halves in a row.
        keys = np.unique(places // step * (none + 1) + ids[places])
        half, term = keys // (none + 1), keys % (none + 1)
        starts = np.flatnonzero(np.diff(half, prepend=-1))
        ends = np.append(starts[1:], len(half))
        last = max(0, (len(words) - 1) // step - 1)
        width = self.maxima.shape[1]
        passages: list[np.ndarray] = []
        # Halves and their sums; the last of a run goes before the next, -2 and a far half stand at the ends.
        at, sums, k = np.array([-2]), np.zeros((1, width), np.float32), 0
        while k <= len(starts):
            # A run of halves whose rows of the table take about run_bytes; at least one half.
            to = max(k + 1, int(np.searchsorted(ends, (starts[k] if k < len(starts) else 0) + run_bytes // (4 * width), "right")))
            if k < len(starts):
                own = np.add.reduceat(self.maxima[term[starts[k]:ends[to - 1]]], starts[k:to] - starts[k], axis=0)
                at, sums = np.append(at[-1:], half[starts[k:to]]), np.concatenate([sums[-1:], own])
            else:
                at, sums = np.append(at[-1:], len(words) + 2), np.concatenate([sums[-1:], np.zeros((1, width), np.float32)])
            beside = at[1:] == at[:-1] + 1
            alone = sums.max(1) >= threshold - 1e-4
            # A gap of halves without terms: the passages at its ends hold one half's terms.
            passages += [at[:-1][beside & ((sums[1:] + sums[:-1]).max(1) >= threshold - 1e-4)],
                         at[:-1][~beside & alone[:-1]], at[1:][~beside & alone[1:]] - 1]
            k = to
        out = []
        for p in np.unique(np.concatenate(passages)).tolist():
            if p < 0 or p > last:
                continue
            lo, hi = p * step, min((p + 2) * step, len(words))
            own = np.unique(ids[lo:hi])
            own = own[own < none]
            if (self.maxima[own].sum(0) < threshold - 1e-4).all():
                continue
            out += [(d, p, s, (lo, hi)) for d, s in self.search(own.tolist(), threshold)]
        return out

    def leaks(self, text: str, threshold: float, min_overlap: float) -> dict[int, tuple[float, float, float, int]]:
        """Verified items of a text: index -> (score, question overlap, answer overlap, first word of the passage)."""
        words = words_of(text)
        found: dict[int, tuple[float, float, float, int]] = {}
        shingles: dict[tuple[int, int, int], set] = {}
        for d, _, score, (lo, hi) in self.candidates(words, threshold):
            shares = []
            for n, part, whole in self.items[d].parts:
                if (lo, hi, n) not in shingles:
                    shingles[lo, hi, n] = grams(words[lo:hi], n) if hi - lo >= n else set()
                share = len(whole & shingles[lo, hi, n]) / len(whole)
                shares.append(share if share == 1 else max(share, in_order(part, words[lo:hi]) / len(part)))
            if shares and min(shares) >= min_overlap and (d not in found or score > found[d][0]):
                found[d] = (score, shares[0], shares[-1], lo)
        return found


def items_for(max_bytes: int, n_terms: int, mean_len: float, block: int = 8) -> int:
    """Items an index may hold so that its table of terms x blocks takes about ``max_bytes``; at least one block's."""
    # x items have at most n_terms terms, and at most x * mean_len.
    return max(block, int(max(max_bytes / 4 * block / n_terms, math.sqrt(max_bytes / 4 * block / mean_len))))


def item_indexes(benchmark: DataFrame, max_items: int = 20_000, max_bytes: int = 1 << 27) -> list[BlockMaxIndex]:
    """An index for each block of about ``max_items`` items, fewer if its maxima would take over ``max_bytes``;
    document frequencies are over all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("text").rlike(r"[\p{L}\p{N}]"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            bags = [words_of(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"n": pa.array(list(map(len, bags)), pa.int64()),
                                   "terms": pa.array([sorted(set(w)) for w in bags], pa.list_(pa.string()))})

    bags = items.select("text").mapInArrow(terms, "n long, terms array<string>").where("n > 0")
    n_items, mean_len = bags.agg(F.count(F.lit(1)), F.avg("n")).first()
    df_all = bags.select(F.explode("terms").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    if n_items:
        max_items = min(max_items, items_for(max_bytes, df_all.count(), mean_len))
    n_blocks, out = -(-n_items // max_items), []
    for k in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        # One block's items, about max_items of them, and the frequencies of their terms.
        block = sorted((-1 if r["item_id"] is None else r["item_id"], r["text"]) for r in mine.collect() if words_of(r["text"]))
        if block:
            used = mine.select("text").mapInArrow(terms, "n long, terms array<string>").select(F.explode("terms").alias("w")).distinct()
            out.append(BlockMaxIndex(block, {r["w"]: r["df"] for r in df_all.join(used, "w").collect()}, n_items, mean_len))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.6, min_overlap: float = 0.5, max_items: int = 20_000) -> DataFrame:
    """A row per document and leaked item: ids, BM25 score, question and answer overlap, first word of the passage."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_leak_text")).where(F.col("_leak_text").isNotNull())
    parts = []
    for block in item_indexes(benchmark, max_items):
        index = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                found = [(r, d, *x) for r, t in enumerate(b.column("_leak_text").to_pylist())
                         for d, x in sorted(index.value.leaks(t, threshold, min_overlap).items())]
                cols = list(zip(*found)) or [()] * 6
                yield pa.record_batch(
                    [b.column(id_col).take(pa.array(cols[0], pa.int64())),
                     pa.array([index.value.items[d].item_id for d in cols[1]], pa.int64()),
                     *(pa.array(c, pa.float64()) for c in cols[2:5]), pa.array(cols[5], pa.int64())],
                    [id_col, "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

        parts.append(rows.mapInArrow(search, schema))
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.6,
                  min_overlap: float = 0.5, max_items: int = 20_000) -> DataFrame:
    """The rows that leak no item, with all their columns."""
    for block in item_indexes(benchmark, max_items):
        index = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in small(batches):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not index.value.leaks(t or "", threshold, min_overlap) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
