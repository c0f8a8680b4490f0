"""Content and boilerplate lines by a linear-chain CRF (operator 4).

Lines of a document are a sequence labelled content (1) or boilerplate (0).  Features of a line are
counts of character classes, word repetition and repeats of the line; they are taken from the
whole text, a batch at a time, with numpy.  The CRF is trained by maximum conditional likelihood
(forward-backward) on lines of labelled documents, whose quality label stands for each of
their lines.  Viterbi decoding marks the lines of every document, and the share of words on content
lines decides: below ``min_share`` the document goes.

The fit uses at most ``max_docs`` labelled documents (smallest id hashes).  Base
measures and decoding cover whole texts.

Cases: a null or empty text has no words and fails the base rule; lines without a word are not
labelled; a null quality or label id is no label; an id with two labels counts by the smaller; if
either class is missing from the labels, every line is content; repeated rows are judged each; an empty table gives
no rows.  Columns beyond the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
N_FEATURES = 10

_CLASS = np.zeros(256, np.uint8)  # bit 0 white space, 1 symbol, 2 upper-case, 3 digit, 4 other ASCII punctuation
_CLASS[list(SPACES.encode())] |= 1
_CLASS[list(SYMBOLS.encode())] |= 2
_CLASS[65:91] |= 4
_CLASS[48:58] |= 8
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in SYMBOLS]] |= 16


def lines_of(text: str) -> list[bytes]:
    """The lines with a word, as UTF-8."""
    return [x for x in text.encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]


def features(docs: list[list[bytes]]) -> np.ndarray:
    """A row of features per line of all ``docs``."""
    lines = [x for d in docs for x in d]
    if not lines:
        return np.zeros((0, N_FEATURES))
    size = np.array(list(map(len, lines)))
    kinds = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    starts = np.cumsum(size) - size
    counts = [np.add.reduceat(((kinds >> k) & 1).astype(np.int32), starts) for k in range(5)]
    words = [x.split() for x in lines]
    n = np.array(list(map(len, words)))
    distinct = np.array([len(set(w)) for w in words])
    again = np.zeros(len(lines))
    at = 0
    for d in docs:
        seen: set[bytes] = set()
        for k, x in enumerate(d):
            if x in seen:
                again[at + k] = 1
            seen.add(x)
        at += len(d)
    solid = np.maximum(size - counts[0], 1)
    return np.column_stack([
        np.ones(len(lines)), np.minimum(counts[1] / solid * 5, 1), np.minimum(counts[2] / solid, 1), counts[3] / solid,
        np.minimum(counts[4] / solid * 5, 1), 1 - distinct / n, (n >= 8) * (1 - distinct / n > 0.5), np.log1p(n) / 5,
        again, np.minimum(solid / n / 20, 1)])


@dataclass
class LineCRF:
    """``emit`` (2 x features), ``move`` (from, to) and ``first`` (2) scores."""

    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray

    def viterbi(self, x: np.ndarray) -> list[int]:
        """The best labels of one document's lines."""
        score = (x @ self.emit.T).tolist()
        if not score:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0][0] + float(self.first[0]), score[0][1] + float(self.first[1])
        back = []
        for s0, s1 in score[1:]:
            from0, from1 = (0 if a + m00 >= b + m10 else 1), (0 if a + m01 > b + m11 else 1)
            back.append((from0, from1))
            a, b = max(a + m00, b + m10) + s0, max(a + m01, b + m11) + s1
        out = [int(b >= a)]
        for f in reversed(back):
            out.append(f[out[-1]])
        return out[::-1]


def fit_crf(seqs: list[tuple[np.ndarray, np.ndarray]], steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> LineCRF:
    """Maximum likelihood by Adam; sequences are padded to one length within groups of like length."""
    seqs = sorted((s for s in seqs if len(s[1])), key=lambda s: len(s[1]))
    k = seqs[0][0].shape[1]
    groups = []
    i = 0
    while i < len(seqs):
        j = i
        while j < len(seqs) and len(seqs[j][1]) <= 1.3 * len(seqs[i][1]) + 1:
            j += 1
        t = len(seqs[j - 1][1])
        x, y, on = np.zeros((j - i, t, k)), np.zeros((j - i, t), int), np.zeros((j - i, t))
        for r, (a, b) in enumerate(seqs[i:j]):
            x[r, :len(b)], y[r, :len(b)], on[r, :len(b)] = a, b, 1
        groups.append((x, y, on))
        i = j
    total = sum(len(s[1]) for s in seqs)
    par = np.zeros(2 * k + 6)
    m, v = np.zeros_like(par), np.zeros_like(par)
    lse = lambda a, axis: np.logaddexp.reduce(a, axis)
    for step in range(1, steps + 1):
        emit, move, first = par[:2 * k].reshape(2, k), par[2 * k:2 * k + 4].reshape(2, 2), par[2 * k + 4:]
        g_emit, g_move, g_first = np.zeros((2, k)), np.zeros((2, 2)), np.zeros(2)
        for x, y, on in groups:
            n, t, _ = x.shape
            s = x @ emit.T
            alpha, beta = np.zeros((t, n, 2)), np.zeros((t, n, 2))
            alpha[0] = s[:, 0] + first
            for q in range(1, t):
                new = lse(alpha[q - 1][:, :, None] + move, 1) + s[:, q]
                alpha[q] = np.where(on[:, q, None] > 0, new, alpha[q - 1])
            for q in range(t - 2, -1, -1):
                new = lse(move + (s[:, q + 1] + beta[q + 1])[:, None, :], 2)
                beta[q] = np.where(on[:, q + 1, None] > 0, new, 0)
            z = lse(alpha[-1], 1)
            post = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * on[:, :, None]
            gold = np.eye(2)[y] * on[:, :, None]
            g_emit += np.einsum("ntl,ntk->lk", post - gold, x)
            g_first += (post - gold)[:, 0].sum(0)
            for q in range(1, t):
                w = on[:, q]
                pair = np.exp(alpha[q - 1][:, :, None] + move + (s[:, q] + beta[q])[:, None, :] - z[:, None, None])
                g_move += (pair * w[:, None, None]).sum(0)
                np.add.at(g_move, (y[:, q - 1], y[:, q]), -w)
        g = np.concatenate([g_emit.ravel(), g_move.ravel(), g_first]) / total + l2 * par
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return LineCRF(par[:2 * k].reshape(2, k), par[2 * k:2 * k + 4].reshape(2, 2), par[2 * k + 4:])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_docs: int = 4_000, max_lines: int = 2_000) -> LineCRF | None:
    """Fit on at most ``max_docs`` labelled documents, half of each quality, and ``max_lines`` lines of each.

    None if a class is missing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()) \
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for q in (0, 1)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = [lines_of(t or "") for t in b.column("text").to_pylist()]
            x = features(texts).astype(np.float32)
            starts = np.cumsum([0, *map(len, texts)])
            yield pa.record_batch({"quality": b.column("quality"),
                                   "x": pa.array([x[s:s + min(len(t), max_lines)].tobytes() for t, s in zip(texts, starts)], pa.binary())})

    # At most max_docs ids: bounded, so broadcast.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")) \
        .join(F.broadcast(part[0].unionByName(part[1])), "doc_id").select(F.col("quality").cast("int").alias("quality"), "text")
    seqs = []
    for r in rows.mapInArrow(measure, "quality int, x binary").collect():
        x = np.frombuffer(bytes(r["x"]), np.float32).reshape(-1, N_FEATURES)
        seqs.append((x, np.full(len(x), r["quality"])))
    if len({int(y[0]) for _, y in seqs if len(y)}) < 2:
        return None
    return fit_crf(seqs)


def repeated_words(words: list) -> int:
    """Words in 3-word windows that occur twice or more, each word once."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    seen: dict = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    n = covered = 0
    for k, g in enumerate(grams):
        if seen[g] > 1:
            n += k + 3 - max(covered, k)
            covered = k + 3
    return n


def judge(docs: DataFrame, model: LineCRF | None, id_col: str = "doc_id", text_col: str = "text",
          min_share: float = 0.5, min_words: int = 50) -> DataFrame:
    """Base measures, content share and verdict of every document."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_crf_text"))
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column("_crf_text").to_pylist()
            out: list[list] = [[] for _ in range(8)]
            lines = [lines_of(t) for t in texts]
            x = features(lines)
            at = 0
            for t, own in zip(texts, lines):
                words = t.encode("utf-8", "surrogatepass").split()
                n, again = len(words), repeated_words(words)
                seen_lines = len(own) - len(set(own))
                marks = [1] * len(own) if model is None else model.viterbi(x[at:at + len(own)])
                at += len(own)
                share = sum(len(y.split()) for y, m in zip(own, marks) if m) / n if n else 0.0
                failed = n < min_words or 100 * again > 50 * n
                values = (n, len(t) - sum(map(t.count, SPACES)), sum(map(t.count, SYMBOLS)), seen_lines, again, failed,
                          not failed and share >= min_share, share)
                for c, y in zip(out, values):
                    c.append(y)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.record_batch([b.column(id_col), *(pa.array(c, t) for c, t in zip(out, types))],
                                  [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                   "base_failed", "kept", "content_share"])

    return rows.mapInArrow(apply, f"{id_col} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                  "n_repeat_words long, base_failed boolean, kept boolean, content_share double")
