"""Toxicity by non-negative positive-unlabelled learning (operator 9).

Confirmed toxic rows are the positives; the unlabelled text is a sample of the labelled rows with
their labels hidden, so it is a mixture whose share of positives, the class prior, is known from
the counts of all fit labels.  A linear classifier over word presence minimises

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss; when the corrected negative risk falls below zero the step climbs it
back, as the non-negative estimator asks.  Features are words and their beginnings of 4, 5 and 6
letters (``^lett``, which join inflected forms); the vocabulary is those that positives hold more
often than unlabelled text does, by their z-score.

Only the fit sees labels, and only from rows outside the held-out fold (crc32 of the id as text,
modulo ``folds``, is 0).  The fit is on a bounded sample: ``max_positive`` and
``max_unlabelled`` rows, those with the smallest id hashes.  Scoring reads every whole text.

Cases: a null or empty text has the bias as its score; a null id is held out; null
labels or label ids are no labels; an id labelled twice is toxic if either says so; repeated rows
are scored each; with no toxic row to learn from, every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small, written

WORD = re.compile(r"[^\W\d_]+")


def features(text: str) -> set[str]:
    """The words of a text and their beginnings."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({"^" + w[:n] for w in words if len(w) > n} for n in (4, 5, 6)))


@dataclass
class Model:
    """Feature weights and bias; ``prior`` is the class prior it was corrected by."""

    weights: dict[str, float]
    bias: float
    prior: float

    def score(self, text: str) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & features(text)))
        return 1 / (1 + np.exp(-min(max(z, -700.0), 700.0)))


def held_out(id_col: str, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


@dataclass
class Rows:
    """Rows of 0/1 features: the row and column of every 1, and the number of rows."""

    row: np.ndarray
    col: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        """Scores of the rows; the last weight is the bias."""
        return np.bincount(self.row, w[self.col], self.n) + w[-1]

    def mean(self, g: np.ndarray, k: int) -> np.ndarray:
        """The mean over rows of ``g`` times the row's features and bias."""
        return np.append(np.bincount(self.col, g[self.row], k), g.sum()) / self.n


def fit_nnpu(p: Rows, u: Rows, k: int, prior: float, steps: int = 600, rate: float = 0.1,
             l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """``k`` weights and the bias for rows ``p`` (positive) and ``u`` (unlabelled), by Adam on the whole batch."""
    w = np.zeros(k + 1)
    w[k] = np.log(prior / (1 - prior))
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, steps + 1):
        zp, zu = p.dot(w), u.dot(w)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g_neg = u.mean(sig(zu), k) - prior * p.mean(sig(zp), k)
        g = prior * p.mean(sig(zp) - 1, k) + g_neg if negative >= 0 else -g_neg
        g[:k] += l2 * w[:k]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:k], float(w[k])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5,
          max_positive: int = 8_000, max_unlabelled: int = 12_000, vocabulary: int = 1_024, min_df: int = 5,
          min_z: float = 3.0) -> Model | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold; None without a toxic row."""
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", folds))
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n, n_pos = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0))).first()
    if not n_pos:
        return None
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    pos = known.where("toxic = 1").orderBy(*by_hash).limit(max_positive).select("doc_id", F.lit(1).alias("p"), F.lit(0).alias("u"))
    unl = known.orderBy(*by_hash).limit(max_unlabelled).select("doc_id", F.lit(0).alias("p"), F.lit(1).alias("u"))
    sample = pos.unionByName(unl).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("u").alias("u"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [sorted(features(t or "")) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("p"), b.column("u"), pa.array(found, pa.list_(pa.string()))], ["p", "u", "words"])

    # At most max_positive + max_unlabelled ids of 16 bytes: bounded, so broadcast.
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(sample), "doc_id").select("p", "u", "text")
    bags = written(chosen.mapInArrow(words, "p int, u int, words array<string>"), "pu-bags")
    total_p, total_u = bags.agg(F.sum("p"), F.sum("u")).first()
    if not total_p or not total_u:
        return None
    df = bags.select("p", "u", F.explode("words").alias("word")).groupBy("word") \
        .agg(F.sum("p").alias("dp"), F.sum("u").alias("du")).where(F.col("dp") >= min_df)
    rate = (F.col("dp") + F.col("du")) / (total_p + total_u)
    z = (F.col("dp") / total_p - F.col("du") / total_u) / F.sqrt(rate * (1 - rate) * (1 / total_p + 1 / total_u) + 1e-12)
    vocab = [r["word"] for r in df.withColumn("z", z).where(F.col("z") >= min_z)
             .orderBy(F.desc("z"), "word").limit(vocabulary).collect()]
    prior = min(max(n_pos / n, 1e-4), 0.9999)
    if not vocab:
        return Model({}, float(np.log(prior / (1 - prior))), prior)
    found = bags.select("p", "u", F.array_intersect("words", F.array(*map(F.lit, vocab))).alias("words")).collect()
    place = {w: i for i, w in enumerate(vocab)}

    def rows(which: str) -> Rows:
        own = [r["words"] for r in found if r[which] == 1]
        return Rows(np.repeat(np.arange(len(own)), list(map(len, own))), np.array([place[w] for ws in own for w in ws], int), len(own))

    weights, bias = fit_nnpu(rows("p"), rows("u"), len(vocab), prior)
    return Model({w: float(weights[i]) for w, i in place.items()}, bias, prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
          keep: list[str] | None = None) -> DataFrame:
    """``score`` and ``predicted`` for every row, beside the id or the columns in ``keep``."""
    keep = keep or [id_col]
    rows = docs.select(*keep, F.col(text_col).alias("_pu_text"))
    schema = rows.drop("_pu_text").schema.add("score", "double").add("predicted", "integer")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            s = [0.0 if model is None else model.score(t or "") for t in b.column("_pu_text").to_pylist()]
            kept = [b.column(c) for c in keep]
            yield pa.record_batch(kept + [pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
                                  [*keep, "score", "predicted"])

    return rows.mapInArrow(apply, schema)


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            yield b.filter(pa.array([model is None or model.score(t or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train, then score every document: id, held_out, score, predicted."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return scored.select(id_col, held_out(id_col).alias("held_out"), "score", "predicted")
