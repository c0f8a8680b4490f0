"""Importance resampling of documents towards a target text (operator 11).

A text's features are the runs of one word, two words and so on of its words.  Each task codes the words of a slice of
texts once (``ascii_lower``, ``split_pattern_regex``, ``list_flatten``, ``dictionary_encode``).  The runs of n words are the
codes of n - 1 words joined with the word codes shifted by n - 1 places, and coded again, so the CRC of a run is
taken once per slice, and continued from that of the run without its last word.  A run's bucket is its CRC modulo the number of
buckets.  The bucket counts of all documents and of all target texts give a bucket's gain, 1000 times the log of the
ratio of their smoothed shares; a document's weight is the floored mean of the gains of its features, by ``take`` and a
segment sum.  A Gumbel noise made of the id's hash turns the largest scores into a sample without replacement.

The counts are one row per task and bucket, added by a group-by; ``buckets`` gains, a number per bucket, reach the tasks.
The draw numbers the candidates along a global order (``runs.running``), so nothing is sorted in one task.

Cases: a null or empty text, or one without words, has no features and weight 0; a null id has no score and is not a
candidate; rows that repeat an id are documents of their own with equal noise; equal scores go to the smaller id; texts of
any length are taken whole; an empty table gives no rows, an empty target counts as one of no features.  Other columns
are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small, written
from tarmac.llm.runs import running, segments

#: What stands between words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def coded_runs(texts: pa.Array, longest: int = 2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... ``longest`` words: the text of each run, its code, and the CRC of every code."""
    split = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), BETWEEN)
    flat = pc.list_flatten(split)
    full = pc.not_equal(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    owner = pc.list_parent_indices(split).filter(full).to_numpy()
    word = coded.indices.to_numpy().astype(np.int64)
    names = [x.encode() for x in coded.dictionary.to_pylist()]
    crc = np.fromiter(map(zlib.crc32, names), np.int64, len(names))
    yield owner, word, crc
    tails = [b" " + x for x in names]
    run, at = word, np.arange(len(word))
    for n in range(2, longest + 1):
        live = at + n - 1 < len(word)
        live[live] = owner[at[live] + n - 1] == owner[at[live]]
        run, at = run[live], at[live]
        pair = pa.array(run * max(1, len(names)) + word[at + n - 1]).dictionary_encode()
        head, tail = np.divmod(pair.dictionary.to_numpy(), max(1, len(names)))
        crc = np.fromiter(map(zlib.crc32, map(tails.__getitem__, tail.tolist()), crc[head].tolist()), np.int64, len(head))
        run = pair.indices.to_numpy().astype(np.int64)
        yield owner[at], run, crc


def bucket_counts(texts: DataFrame, text_col: str = "text", longest: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Features of all texts by bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in small(batches, 2_000):
            for _, run, crc in coded_runs(b.column(0), longest):
                total += np.bincount(crc[run] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(at.astype(np.int64)), "n": pa.array(total[at])})

    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000 log ratio of the target's and the source's smoothed share of each bucket."""
    s, t, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + n) / (float(a + 1) * float(t + n))))
                     for a, b in zip(source.tolist(), target.tolist())], np.int64)


def measured(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 2) -> DataFrame:
    """``id, n_words, n_features, weight`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 2_000):
            n, words, total = np.zeros(b.num_rows, np.int64), None, np.zeros(b.num_rows, np.int64)
            for owner, run, crc in coded_runs(b.column("text"), longest):
                if len(owner):
                    gain_of = pa.array(sent.value[crc % len(sent.value)]).take(pa.array(run)).to_numpy()
                    first = segments(owner)
                    total[owner[first]] += np.add.reduceat(gain_of, first)
                    n[owner[first]] += np.diff(np.append(first, len(owner)))
                words = n.copy() if words is None else words
            yield pa.record_batch([b.column("id"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                  ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(weigh, "id long, n_words long, n_features long, weight long")


def gumbel(id_col: Column, seed: int = 7) -> Column:
    """Floored 1000 times Gumbel noise of an id: the first 32 bits of the SHA-256 of ``seed:id`` as a uniform number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 2,
               buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """A row per document: id, ``n_features``, ``weight``, ``score``, ``rank`` (null: not drawn), ``n_words``.

    Of the documents with ``least_words`` or more, ``percent`` of a hundred (floored) are drawn.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets))
    # Written once, with a number of its own for every row: a third of all rows may repeat one id.
    rows = written(measured(docs, gain, id_col, text_col, longest).withColumn("row", F.monotonically_increasing_id())
                   .withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "resample")
    live = F.col("id").isNotNull() & (F.col("n_words") >= least_words)
    n = rows.where(live).count()
    placed = running(rows.where(live).withColumn("all", F.lit(0).cast("long")), "all", [F.desc("score"), F.asc("id"), F.asc("row")], count="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = rows.where(~live).withColumn("rank", F.lit(None).cast("long"))
    return placed.drop("all").unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The drawn documents with all their columns; the rows of an id stay together."""
    ids = importance(docs, target, id_col, text_col, **settings).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    key = docs.select(id_col).columns[0]
    return docs.join(ids, docs[key].cast("long") == ids["_drawn"], "left_semi")


def duckdb_crc32(text: str) -> str:
    """DuckDB expression: unsigned CRC-32 of a string's UTF-8 bytes, four bits at a time."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table.append(f"{c}::BIGINT")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode({text}))) + 1), lambda i: "
            f"(strpos('0123456789ABCDEF', hex(encode({text}))[i + 1 - 2 * ((i + 1) % 2)]) - 1)::BIGINT)), "
            f"lambda c, v: xor(c >> 4, [{', '.join(table)}][(xor(c, v) & 15) + 1])), 4294967295)")


SQL = rf"""
WITH t AS (
  SELECT 0 AS of_target, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT of_target, r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM t),
f AS (
  SELECT of_target, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS g FROM w),
crc AS (SELECT g, {duckdb_crc32("g")} % 10000 AS b FROM (SELECT DISTINCT g FROM f)),
fb AS (SELECT of_target, r, b FROM f JOIN crc USING (g)),
counts AS (SELECT b, count(*) FILTER (of_target = 0) AS s, count(*) FILTER (of_target = 1) AS t FROM fb GROUP BY b),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS big_s, coalesce(sum(t), 0)::DOUBLE AS big_t FROM counts),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (big_s + 10000) / ((s + 1)::DOUBLE * (big_t + 10000))))::BIGINT AS g FROM counts, sums),
per AS (SELECT r, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM fb JOIN gain USING (b) WHERE of_target = 0 GROUP BY r),
scored AS (
  SELECT w.r, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN per USING (r) WHERE of_target = 0),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS big_n
           FROM scored WHERE n_words >= 20 AND doc_id IS NOT NULL)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN place <= 25 * big_n // 100 THEN CAST(place AS BIGINT) END AS rank, CAST(n_words AS BIGINT) AS n_words
FROM scored LEFT JOIN placed USING (r)
"""
