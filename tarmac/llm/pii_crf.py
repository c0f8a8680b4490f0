"""Personal data by base patterns and a skip-chain CRF (operator 7).

Base spans are the leftmost, non-overlapping pattern matches that pass their checks.  The skip-chain CRF
then labels the words that could be personal data (those with a digit, ``@`` or ``+``).  Neighbouring
candidate words share a transition potential; equal words and words with the same digits share a skip potential
however far apart they stand, each linked to its next occurrence, so a document with a
thousand copies of a word has a thousand links.  Loopy sum-product message passing runs for ``rounds``
rounds over all candidates of a batch at once; a word whose best label is sure enough
joins a span.  A span whose words all lack base spans is added, unless it only continues a base span of its
kind beside it; base spans always stay.

The potentials are trained by pseudo-likelihood, the skip potential from a prior that equal words
agree.  Base spans label the words of at most ``max_docs`` documents (smallest id hashes).  A failed
match over several words, such as a card number after another number, says nothing of each of them: they
are left out of the fit, and are what the CRF can add later.  Detection covers whole texts.

Cases: a null or empty text has no spans; repeated rows are searched each; a null id is kept;
without any base span in the sample the CRF adds nothing; an empty table gives no rows; long runs
of digits or address characters are read once, never quadratically.  Columns beyond the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import small


KINDS = ["email", "ip", "card", "phone"]
LABELS = ["none", *KINDS]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@+]")
_SPACE = re.compile(r"\s")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        # Characters up to here can't belong to a later local part: '@' ends a run.
        done = found.end() if found else at + 1
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the stated patterns, by kind and then start; code points, end exclusive."""
    out: list[Span] = [("email", s, e) for s, e in _emails(text)]
    if not re.search("[0-9]", text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = re.sub("[ -]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """Words with a digit, ``@`` or ``+``: start and end without outer punctuation (but ``+`` and ``(`` before)."""
    out, at = [], 0
    while found := _MARK.search(text, at):
        start = found.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        space = _SPACE.search(text, found.end())
        at = end = space.start() if space else len(text)
        while end > found.start() + 1 and not text[end - 1].isalnum() and text[end - 1] != ")":
            end -= 1
        while start < found.start() and not text[start].isalnum() and text[start] not in "+(":
            start += 1
        out.append((start, end))
    return out


def shape(word: str) -> list[str]:
    """The features of a candidate word."""
    digits = sum(c.isdigit() for c in word)
    form = re.sub("[0-9]+", lambda m: f"9{{{min(len(m[0]), 20)}}}", re.sub(r"[^\W\d_]+", "a", word))[:24]
    out = [f"form={form}", f"digits={min(digits, 20)}", f"first={word[:1] if not word[:1].isalnum() else 'w'}"]
    if _DOMAIN.search(word.partition("@")[2]) and word[0] != "@":
        out.append("address")
    quads = word.split(".")
    if len(quads) == 4 and all(q.isascii() and q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quads):
        out.append("quad")
    only = re.sub("[ -]", "", word)
    if only.isascii() and only.isdigit() and 16 <= len(only) <= 19:
        out.append("luhn" if luhn(only) else "no-luhn")
    return out


def word_features(text: str, words: list[tuple[int, int]]) -> list[list[str]]:
    """Features of each candidate, its adjacent candidates' first shapes included."""
    own = [shape(text[s:e]) for s, e in words]
    out = []
    for i, f in enumerate(own):
        near = lambda j: 0 <= j < len(words) and words[max(i, j)][0] - words[min(i, j)][1] <= 2
        out.append(["bias", *f, "before=" + (own[i - 1][0] if near(i - 1) else ""), "after=" + (own[i + 1][0] if near(i + 1) else "")])
    return out


def edges(text: str, words: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges of adjacent candidates, and skip edges from a word to its next equal or same-digit one."""
    chain = [(i, i + 1) for i in range(len(words) - 1) if words[i + 1][0] - words[i][1] <= 2]
    beside, skip, last = set(chain), [], {}
    for i, (s, e) in enumerate(words):
        word = text[s:e].lower()
        digits = re.sub("[^0-9]", "", word)
        keys = {("w", word)} | ({("d", digits)} if len(digits) >= 7 else set())
        skip += sorted({(last[k], i) for k in keys if k in last and (last[k], i) not in beside})
        for k in keys:
            last[k] = i
    return chain, skip


@dataclass
class SkipChainCRF:
    """Node weights by feature, and the potentials of chain (from, to) and skip links (symmetric)."""

    node: dict[str, np.ndarray]
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, feats: list[list[str]], chain: list[tuple[int, int]], skip: list[tuple[int, int]],
                  rounds: int = 6) -> np.ndarray:
        """Label beliefs of every node after ``rounds`` rounds of sum-product."""
        k = len(LABELS)
        zero = np.zeros(k)
        phi = np.array([sum((self.node.get(f, zero) for f in fs), zero) for fs in feats]).reshape(-1, k)
        both = np.array(chain + skip, int).reshape(-1, 2)
        pot = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        src, dst = np.concatenate([both[:, 0], both[:, 1]]), np.concatenate([both[:, 1], both[:, 0]])
        pots = np.concatenate([pot, pot.transpose(0, 2, 1)])
        msg, turn = np.zeros((len(src), k)), np.roll(np.arange(len(src)), len(both))
        belief = phi
        for _ in range(rounds if len(src) else 0):
            out = belief[src] - msg[turn]
            msg = np.logaddexp.reduce(out[:, :, None] + pots, 1)
            msg -= np.logaddexp.reduce(msg, 1)[:, None]
            belief = phi.copy()
            np.add.at(belief, dst, msg)
        return np.exp(belief - np.logaddexp.reduce(belief, 1)[:, None]) if len(phi) else phi


def label_words(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """The label of each candidate word: the kind of a span over it, else none."""
    out, by_start = [0] * len(words), sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))
    k = 0
    for i, (s, e) in enumerate(words):
        while k < len(by_start) and by_start[k][2] <= s:
            k += 1
        for kind, a, b in by_start[k:k + 4]:
            if a < e and b > s:
                out[i] = LABELS.index(kind)
                break
    return out


def training_labels(text: str, words: list[tuple[int, int]]) -> list[int]:
    """The label of each word by base spans; -1 for words that a failed match took in together."""
    spans = base_spans(text)
    out = label_words(words, spans)
    good = set(spans)
    for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
        for m in pattern.finditer(text):
            if (kind, *m.span()) not in good and (" " in m[0] or "(" in m[0]):
                inside = [i for i, (s, e) in enumerate(words) if s < m.end() and e > m.start()] if len(m[0]) > 8 else []
                for i in inside if len(inside) > 1 else []:
                    out[i] = out[i] or -1
    return out


def fit(samples: list[tuple[list[list[str]], list[tuple[int, int]], list[tuple[int, int]], list[int]]],
        steps: int = 120, rate: float = 0.2, l2: float = 1e-3, agree: float = 1.0) -> SkipChainCRF:
    """Pseudo-likelihood by Adam: every node given its neighbours' labels; nodes labelled -1 are left out."""
    k = len(LABELS)
    names: dict[str, int] = {}
    ids, rows, y, ch, sk = [], [], [], [], []
    for feats, chain, skip, labels in samples:
        at = len(y)
        for i, fs in enumerate(feats):
            for f in fs:
                ids.append(names.setdefault(f, len(names)))
                rows.append(at + i)
        ch += [(at + a, at + b) for a, b in chain]
        sk += [(at + a, at + b) for a, b in skip]
        y += labels
    ids, rows, y = np.array(ids, int), np.array(rows, int), np.array(y, int)
    ch, sk = np.array(ch, int).reshape(-1, 2), np.array(sk, int).reshape(-1, 2)
    n, known = len(y), y >= 0
    ch, sk = (e[known[e].all(1)] for e in (ch, sk))
    gold = np.eye(k)[np.maximum(y, 0)]
    prior = agree * np.eye(k)
    node, chain, skip = np.zeros((len(names), k)), np.zeros((k, k)), prior.copy()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (node, chain, skip)]
    for t in range(1, steps + 1):
        z = np.zeros((n, k))
        np.add.at(z, rows, node[ids])
        for e, p in ((ch, chain), (sk, skip)):
            np.add.at(z, e[:, 1], p[y[e[:, 0]]])
            np.add.at(z, e[:, 0], p.T[y[e[:, 1]]])
        g = (np.exp(z - np.logaddexp.reduce(z, 1)[:, None]) - gold) * known[:, None] / n
        g_node, g_chain, g_skip = np.zeros_like(node), np.zeros_like(chain), np.zeros_like(skip)
        np.add.at(g_node, ids, g[rows])
        for e, out in ((ch, g_chain), (sk, g_skip)):
            np.add.at(out, y[e[:, 0]], g[e[:, 1]])
            np.add.at(out.T, y[e[:, 1]], g[e[:, 0]])
        g_skip = (g_skip + g_skip.T) / 2
        for p, grad, s, mean in zip((node, chain, skip), (g_node, g_chain, g_skip), state, (0, 0, prior)):
            grad = grad + l2 / n * (p - mean)
            s[0], s[1] = 0.9 * s[0] + 0.1 * grad, 0.999 * s[1] + 0.001 * grad * grad
            p -= rate * (s[0] / (1 - 0.9 ** t)) / (np.sqrt(s[1] / (1 - 0.999 ** t)) + 1e-8)
    return SkipChainCRF({f: node[i] for f, i in names.items()}, chain, skip)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 20_000,
          max_words: int = 60_000) -> SkipChainCRF | None:
    """Fit on candidate words of at most ``max_docs`` documents: ``max_words`` in all, the first few dozen of each."""
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct() \
        .orderBy(F.xxhash64("id"), "id").limit(max_docs)
    # At most max_docs ids: bounded, so broadcast.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").where(
        F.col("text").rlike("[0-9@+]"))
    per_doc = max(30, 10 * max_words // max_docs)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out = []
            for text in b.column("text").to_pylist():
                words = candidates(text)[:per_doc]
                chain, skip = edges(text, words)
                out.append((word_features(text, words), [list(e) for e in chain], [list(e) for e in skip],
                            training_labels(text, words)))
            pair = pa.list_(pa.list_(pa.int32()))
            types = (pa.list_(pa.list_(pa.string())), pair, pair, pa.list_(pa.int32()))
            yield pa.record_batch([b.column("id").cast(pa.string()), *(pa.array(c, t) for c, t in zip(zip(*out), types))]
                                  if out else [pa.array([], pa.string()), *(pa.array([], t) for t in types)],
                                  ["id", "feats", "chain", "skip", "labels"])

    found = rows.mapInArrow(prepare, "id string, feats array<array<string>>, chain array<array<int>>, "
                                     "skip array<array<int>>, labels array<int>") \
        .orderBy(F.xxhash64("id"), "id", "labels").limit(max_docs).toLocalIterator()
    samples, n = [], 0
    for r in found:
        if n + len(r["labels"]) > max_words:
            break
        samples.append((r["feats"], [tuple(e) for e in r["chain"]], [tuple(e) for e in r["skip"]], r["labels"]))
        n += len(r["labels"])
    return fit(samples) if any(max(s[3], default=0) > 0 for s in samples) else None


def find_spans(texts: list[str], model: SkipChainCRF | None, sure: float = 0.9) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; one message-passing run over all texts."""
    base = [base_spans(t) for t in texts]
    feats: list[list[str]] = []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    places = []
    for t in texts:
        words = candidates(t) if model is not None else []
        at = len(feats)
        c, s = edges(t, words)
        feats += word_features(t, words)
        chain += [(a + at, b + at) for a, b in c]
        skip += [(a + at, b + at) for a, b in s]
        places.append((at, words))
    belief = model.marginals(feats, chain, skip) if feats else None
    alone = {"luhn", "quad", "address"}
    out = []
    for own, (at, words), t in zip(base, places, texts):
        if not words:
            out.append((own, own))
            continue
        best = belief[at:at + len(words)].argmax(1)
        known = label_words(words, own)
        own_shapes = feats[at:at + len(words)]
        added: list[Span] = []
        i = 0
        while i < len(words):
            j = i + 1
            if best[i] and belief[at + i, best[i]] >= sure and not known[i]:
                # Neighbours of a label are one span, but a whole number is one of its own.
                whole = lambda w: len(re.sub("[^0-9]", "", t[w[0]:w[1]])) >= 16
                while j < len(words) and best[j] == best[i] and not known[j] and words[j][0] - words[j - 1][1] <= 2 \
                        and not whole(words[j - 1]) and not whole(words[j]):
                    j += 1
                # A run that continues a neighbouring base span of its kind is that span's context, not a new one,
                # unless it is a whole number or address of its own.
                beside = not alone.intersection(own_shapes[i]) and any(
                    0 <= x < len(words) and known[x] == best[i] and words[max(x, y)][0] - words[min(x, y)][1] <= 2
                    for x, y in ((i - 1, i), (j, j - 1)))
                if not beside:
                    added.append((LABELS[best[i]], words[i][0], words[j - 1][1]))
            i = j
        out.append((own, sorted(own + added, key=lambda s: (KINDS.index(s[0]), s[1]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: SkipChainCRF | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: base counts, the digest of base spans, and all spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_pii_text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column("_pii_text").to_pylist()
            counts: list[list[int]] = [[], [], [], []]
            digests, spans = [], []
            for base, every in find_spans(texts, model):
                for c, k in zip(counts, KINDS):
                    c.append(sum(s[0] == k for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.record_batch([b.column(id_col), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                                   pa.array(spans, pa.string())],
                                  [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return rows.mapInArrow(apply, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, "
                                  "base_sha256 string, spans string")


def redact(docs: DataFrame, model: SkipChainCRF | None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in capitals; the other columns pass through."""
    def mask(text: str, spans: list[Span]) -> str:
        out, at = [], 0
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= at:
                out += [text[at:s], f"[{kind.upper()}]"]
            at = max(at, e)
        return "".join(out) + text[at:]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = b.column(text_col).to_pylist()
            found = find_spans([t or "" for t in texts], model)
            new = [None if t is None else mask(t, every) if every else t for t, (_, every) in zip(texts, found)]
            yield b.set_column(b.schema.get_field_index(text_col), text_col, pa.array(new, pa.string()))

    return docs.mapInArrow(apply, docs.schema)
