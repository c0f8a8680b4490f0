"""SentencePiece encoding and decoding by a weighted transducer (operator 8).

Three machines are compiled from a model file: the normaliser (space to the meta symbol, dummy
prefix), the piece transducer (a trie whose final arcs emit a piece's id) and byte fallback (a
character of no piece emits its UTF-8 bytes' ids).  An input is composed with them and the
tropical-semiring shortest path is its encoding.

Weights make the path the model's own encoding.  In a unigram model an arc costs the negated score.  In
a BPE model scores rank merges and their sum means nothing, so a bigram acceptor is composed too: two
pieces may follow each other (weight 0, else infinity) if merging their joined characters
in rank order never crosses the border between them.  A segmentation whose adjacent pieces are
all admitted is the one that BPE merging gives, so exactly one path has a finite weight.

Pieces never hold the meta symbol after another character nor a line feed (checked when compiling),
so the shortest path of a text is the chain of those of its words, which are remembered.
Decoding maps ids back, bytes included, and undoes the normaliser.

Cases: a null text encodes as an empty one (no pieces); a literal meta symbol in a text decodes as
a space, as in the model's library; repeated rows are encoded each; an empty table gives no rows; a word
of any length is encoded whole.  Columns beyond the id and the text are not read unless kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import WordMemo, chunks, small

META = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceTransducer:
    """The compiled machines of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only the identity normaliser with escaped white space is supported")
        if model.trainer_spec.model_type not in (UNIGRAM, BPE) or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("only unigram and BPE models of normal, control and byte pieces are supported")
        self.prefix = META if norm.add_dummy_prefix else ""
        self.bpe = model.trainer_spec.model_type == BPE
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.unknown = min(self.score.values()) - 10
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unk_id = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        if any(re.search(f"[^{META}]{META}|\n", p) for p in self.ids):
            raise ValueError("a piece crosses a word border")
        # The piece transducer: a trie of states (arcs by character, and the piece of a final state).
        self.trie: list = [{}, None]
        # BPE merging must make a piece of its own characters; one that it can't make has no arc.
        self._pairs: dict[tuple[str, str], bool] = {}
        for p in self.ids:
            if not self.bpe or not self._crosses(p, 0):
                at = self.trie
                for c in p:
                    at = at[0].setdefault(c, [{}, None])
                at[1] = p
        self.longest = max(map(len, self.ids), default=1)
        # The next shorter arc beside a piece's: the longest piece that it starts with, at last its first character.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if self._is_arc(p[:k])), p[0]) for p in self.ids if len(p) > 1}
        size = len(model.pieces)
        surface = [b""] * size
        for p, i in self.ids.items():
            surface[i] = p.replace(META, " ").encode()
        for b, i in self.byte.items():
            surface[i] = bytes([b])
        surface[self.unk_id] = " ⁇ ".encode()
        self._len = np.array(list(map(len, surface)))
        self._at = np.cumsum(self._len) - self._len
        self._bytes = np.frombuffer(b"".join(surface), np.uint8)
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32

    def _is_arc(self, text: str) -> bool:
        at = self.trie
        for c in text:
            at = at[0].get(c)
            if at is None:
                return False
        return at[1] is not None

    def _crosses(self, text: str, border: int) -> bool:
        """Does merging the characters of ``text`` in rank order ever join across ``border``?  ``border`` 0: is it left in parts?"""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, k = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, k = s, i
            if best is None:
                break
            if border and sum(map(len, parts[:k + 1])) == border:
                return True
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        return False if border else len(parts) > 1

    def _follows(self, left: str, right: str) -> bool:
        """The bigram acceptor's arc."""
        key = left, right
        ok = self._pairs.get(key)
        if ok is None:
            if len(self._pairs) > 400_000:
                self._pairs.clear()
            ok = self._pairs[key] = not self._crosses(left + right, len(left))
        return ok

    def shortest_path(self, word: str) -> list[str]:
        """The pieces of the best path of a normalised word."""
        return self._admitted_path(word) if self.bpe else self._cheapest_path(word)

    def _admitted_path(self, word: str) -> list[str]:
        """The one path of finite weight of a BPE model.

        A state of the composition is a place and the piece before it.  The text before a
        place has one admitted segmentation at most, so a place that is left without reaching the end is not
        tried again.  Long pieces first: nearly always the first admitted one is on the path.
        """
        pairs, trie, shorter, longest, n, i = self._pairs, self.trie, self.shorter, self.longest, len(word), 0
        path: list[str] = []
        closed: set[int] = set()
        last = None
        while i < n:
            at, p = trie, word[i]  # byte fallback if no piece starts here
            for c in word[i:i + longest]:
                at = at[0].get(c)
                if at is None:
                    break
                if at[1] is not None:
                    p = at[1]
            while True:
                if p is None:  # no arc is left
                    if not path:
                        raise ValueError(f"no path for {word!r}")
                    closed.add(i)
                    p = path.pop()
                    i -= len(p)
                    last = path[-1] if path else None
                elif not closed or i + len(p) not in closed:
                    ok = pairs.get((last, p)) if last is not None else True
                    if ok or ok is None and self._follows(last, p):
                        break
                p = shorter.get(p)
            path.append(p)
            i += len(p)
            last = p
        return path

    def _cheapest_path(self, word: str) -> list[str]:
        """The path of least weight of a unigram model, place by place."""
        n, inf = len(word), float("inf")
        weight, piece = [0.0] + [inf] * n, [""] * (n + 1)
        for i in range(n):
            at, arcs = self.trie, [word[i]]  # a character of no piece is an arc too, so every place is reached
            for c in word[i:i + self.longest]:
                at = at[0].get(c)
                if at is None:
                    break
                if at[1] is not None and len(at[1]) > 1:
                    arcs.append(at[1])
            for p in arcs:
                total = weight[i] - self.score.get(p, self.unknown)
                if total < weight[i + len(p)]:
                    weight[i + len(p)], piece[i + len(p)] = total, p
        path = []
        while n:
            path.append(piece[n])
            n -= len(piece[n])
        return path[::-1]

    def emit(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character of no piece gives its bytes, or the unknown id without byte pieces."""
        out = list(map(self.ids.get, pieces))
        if None not in out:
            return out
        out = []
        for p in pieces:
            i = self.ids.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk_id)
        return out

    def words(self, text: str) -> list[str]:
        """The normalised text, cut at word borders."""
        return re.findall(f"\n|{META}*[^{META}\n]+|{META}+", self.prefix + text.replace(" ", META)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in self.emit(self.shortest_path(w))]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids, without the dummy prefix."""
        ids = np.asarray(ids, np.int64)
        size = self._len[ids]
        ends = np.cumsum(size)
        if not len(ids) or not ends[-1]:
            return b""
        out = self._bytes[np.arange(ends[-1]) + np.repeat(self._at[ids] - (ends - size), size)].tobytes()
        return out[1:] if self.prefix and out[:1] == b" " else out


_COMPILED: dict[str, tuple[PieceTransducer, WordMemo]] = {}


def compiled(path: str) -> tuple[PieceTransducer, WordMemo]:
    """The transducer of a file and the memo of its words' ids, kept by a worker."""
    if path not in _COMPILED:
        fst = PieceTransducer(path)

        def fill(words: list[str]) -> list[bytes]:
            return [np.array(fst.emit(fst.shortest_path(w)), fst.kind).tobytes() for w in words]

        _COMPILED[path] = fst, WordMemo(fill, 200_000)
    return _COMPILED[path]


def encode_texts(path: str, texts: list[str]) -> list[np.ndarray]:
    fst, memo = compiled(path)
    return [np.frombuffer(x, fst.kind) for x in memo.joined([fst.words(t) for t in texts])]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = True) -> DataFrame:
    """Encode, decode again: id, ``n_pieces``, ``n_bytes`` (byte pieces), ``ids_crc32`` (32-bit little-endian),
    ``round_trip`` (decoding gives the text back), and ``ids`` if asked for."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_fst_text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            at = 0
            for texts in chunks(b.column("_fst_text").to_pylist(), len, 2_000_000):
                fst, _ = compiled(model_path)
                low, high = (min(fst.byte.values()), max(fst.byte.values())) if fst.byte else (1, 0)
                found = encode_texts(model_path, texts)
                cols = {id_col: b.column(id_col).slice(at, len(texts)),
                        "n_pieces": pa.array(list(map(len, found)), pa.int64()),
                        "n_bytes": pa.array([int(((x >= low) & (x <= high)).sum()) for x in found], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in found], pa.int64()),
                        "round_trip": pa.array([fst.decode(x) == t.replace(META, " ").encode("utf-8", "surrogatepass")
                                                for x, t in zip(found, texts)], pa.bool_())}
                if with_ids:
                    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*found, np.zeros(0, fst.kind)]).astype(np.int32)))
                at += len(texts)
                yield pa.record_batch(cols)

    return rows.mapInArrow(apply, f"{id_col} {kind}, n_pieces long, n_bytes long, ids_crc32 long, round_trip boolean"
                           + (", ids array<int>" if with_ids else ""))
