"""Token ids as wavelet-matrix shards (operator 2).

``write_tokens`` encodes every whole text and writes the ids, with an end id after each document,
as shards in ascending id order.  A shard is one file: a document table and a wavelet matrix, i.e.
one bit plane per bit of the ids, the highest first.  Each plane holds that bit of every id in the
order of the plane above it, stably parted by that plane's bit; with the running counts of ones
(``rank``) a token, a symbol's count in any range and the place of its k-th occurrence are each
found in as many steps as there are planes, without decoding the rest.  Planes are
zstd-compressed one by one.

Cases: a null text is an empty one (end id only); a null id sorts first; rows that repeat are
encoded each; an empty table gives no shard.  A shard closes at ``shard_tokens`` ids and holds
whole documents, so memory is bounded by that and the longest document.  Columns beyond the id
and the text are not read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import WordMemo, chunks, open_in, open_out, scratch, written

MAGIC = b"TWM1"
BLOCK = 512  # bits for each entry of a plane's rank directory


class Plane:
    """A bit vector with rank and select; the rank directory is counted when it is first asked for."""

    def __init__(self, packed: np.ndarray, n: int):
        self.packed, self.n = packed, n
        self.ones = int(np.bitwise_count(packed).sum(dtype=np.int64))

    @cached_property
    def before(self) -> np.ndarray:
        """Ones before each block."""
        running = np.concatenate([[0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)])
        return running[np.minimum(np.arange(0, len(self.packed) + BLOCK // 8, BLOCK // 8), len(self.packed))]

    def bit(self, i: int) -> int:
        return int(self.packed[i >> 3] >> (7 - (i & 7))) & 1

    def rank1(self, i: int) -> int:
        """Ones among the first ``i`` bits."""
        block, byte = i // BLOCK, i >> 3
        out = int(self.before[block]) + int(np.bitwise_count(self.packed[block * (BLOCK // 8):byte]).sum())
        return out + (int(self.packed[byte]) >> (8 - (i & 7))).bit_count() if i & 7 else out

    def rank(self, bit: int, i: int) -> int:
        return self.rank1(i) if bit else i - self.rank1(i)

    def select(self, bit: int, k: int) -> int:
        """Place of the ``k``-th (from 0) bit of this value."""
        starts = np.minimum(np.arange(len(self.before)) * BLOCK, self.n)
        count = self.before if bit else starts - self.before
        block = int(np.searchsorted(count, k, side="right")) - 1
        part = np.unpackbits(self.packed[block * (BLOCK // 8):(block + 1) * (BLOCK // 8)])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(part == bit)[k - int(count[block])])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.packed, count=self.n).view(bool)


def parted(bits: np.ndarray) -> np.ndarray:
    """Places of the zeros, then of the ones."""
    return np.concatenate([np.flatnonzero(~bits), np.flatnonzero(bits)])


class WaveletMatrix:
    """Succinct sequence of ids below ``2 ** levels``."""

    def __init__(self, planes: list[Plane], n: int):
        self.planes, self.n, self.levels = planes, n, len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> "WaveletMatrix":
        planes, a = [], ids
        for level in range(levels - 1, -1, -1):
            bits = (a & a.dtype.type(1 << level)) != 0
            planes.append(Plane(np.packbits(bits), len(a)))
            a = np.concatenate([np.compress(~bits, a), np.compress(bits, a)])
        return cls(planes, len(ids))

    def ids(self) -> np.ndarray:
        """The whole sequence, plane by plane from the lowest."""
        a = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            a[self.n - plane.ones:] |= a.dtype.type(1 << level)
            up = np.empty_like(a)
            up[parted(plane.bits())] = a
            a = up
        return a

    def access(self, i: int) -> int:
        out = 0
        for p in self.planes:
            b = p.bit(i)
            i = p.rank1(i) + p.n - p.ones if b else i - p.rank1(i)
            out = out * 2 + b
        return out

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        for level, p in zip(range(self.levels - 1, -1, -1), self.planes):
            b = symbol >> level & 1
            zeros = (p.n - p.ones) * b
            lo, hi = zeros + p.rank(b, lo), zeros + p.rank(b, hi)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``symbol`` at places ``lo`` to ``hi`` (exclusive)."""
        if symbol < 0 or symbol >> self.levels:
            return 0
        lo, hi = self._range(symbol, lo, self.n if hi is None else hi)
        return hi - lo

    def select(self, symbol: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of ``symbol``."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        i = self._range(symbol, 0, self.n)[0] + k
        for level, p in enumerate(reversed(self.planes)):
            b = symbol >> level & 1
            i = p.select(b, i - (p.n - p.ones) * b)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]


def dump(ids: np.ndarray, levels: int, doc_table: pa.Table) -> bytes:
    """A shard's bytes."""
    press = zstandard.ZstdCompressor(level=1)
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, doc_table.schema) as w:
        w.write_table(doc_table)
    matrix = WaveletMatrix.build(ids, levels)
    parts = [press.compress(sink.getvalue())] + [press.compress(p.packed.tobytes()) for p in matrix.planes]
    head = json.dumps({"n": len(ids), "levels": levels, "sizes": [len(x) for x in parts]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *parts])


def load(data: bytes) -> tuple[WaveletMatrix, pa.Table]:
    """The matrix and the document table of a shard's bytes."""
    if data[:4] != MAGIC:
        raise ValueError("not a wavelet-matrix shard")
    size = struct.unpack("<I", data[4:8])[0]
    head = json.loads(data[8:8 + size])
    at, parts = 8 + size, []
    for x in head["sizes"]:
        parts.append(zstandard.ZstdDecompressor().decompress(data[at:at + x]))
        at += x
    if len(data) != at:
        raise ValueError("shard is cut short or too long")
    planes = [Plane(np.frombuffer(x, np.uint8), head["n"]) for x in parts[1:]]
    return WaveletMatrix(planes, head["n"]), pa.ipc.open_stream(parts[0]).read_all()


def byte_level(text: str) -> str:
    """A text's UTF-8 bytes, each as the character that byte-level models have for it."""
    hidden = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
    return text.encode().decode("latin-1").translate(hidden)


#: The small Latin-1 letters on the byte level.
_SMALL_LATIN = {c: byte_level(chr(c)) for c in range(0xDF, 0x100) if c != 0xF7}
_ENCODERS: dict[str, tuple] = {}


def encoder(path: str) -> tuple[Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], int]:
    """For a file of the ``tokenizers`` library: ``encode(texts)`` (all ids, ids per text) and the bits an id takes.

    If the file's pre-tokenizer is a pattern that never joins text across white space and its normaliser
    treats a space as a boundary (NFC, lower-casing and white-space folding do), a text's ids are those of
    its words in turn, so the library encodes each distinct word once.  The parts that the pattern cuts
    from a word of printable ASCII and Latin-1 letters go to the library's model, each byte as the character
    that the byte-level step has for it (normalising such a word is lower-casing it); other words, and those that hold a
    special token's text, go through the whole library.  With any other file whole texts do.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        levels = max(1, max(tok.get_vocab(with_added_tokens=True).values()).bit_length())
        kind = np.uint16 if levels <= 16 else np.uint32
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        first, *rest = pre.get("pretokenizers") or [pre]
        pattern = (first.get("pattern") or {}).get("Regex", "") if first.get("type") == "Split" else ""
        by_word = first.get("invert") and first.get("behavior") == "Removed" and pattern.endswith(r"[^\s\p{L}\p{N}]+") \
            and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in rest) and all(
                x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"}
                for x in norm.get("normalizers", [norm] if norm else []))
        plain = by_word and "Lowercase" in str(norm) and spec["model"]["type"] == "BPE"
        special = [t["content"] for t in spec.get("added_tokens", [])]

        def raw(texts: list[str]) -> list[bytes]:
            return [np.array(e.ids, kind).tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

        parts = re.compile(pattern.replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")).findall if plain else None
        simple = re.compile("[!-~À-ÖØ-öø-ÿ]+" if rest else "[!-~]+").fullmatch
        tokenize, code = tok.model.tokenize, "H" if kind == np.uint16 else "I"

        def words_ids(words: list[str]) -> list[bytes]:
            marked = any(x in t for t in ("\n".join(words),) for x in special)
            whole = [w for w in words if not (plain and simple(w)) or marked and any(x in w for x in special)]
            known = dict(zip(whole, raw(whole)))
            out = []
            for w in words:
                x = known.get(w)
                if x is None:
                    low = w.lower()
                    if low.isalpha():
                        x = [t.id for t in tokenize(low if low.isascii() else low.translate(_SMALL_LATIN))]
                    else:
                        x = [t.id for p in parts(low) for t in tokenize(p if p.isascii() else p.translate(_SMALL_LATIN))]
                    x = array(code, x).tobytes()
                out.append(x)
            return out

        memo = WordMemo(words_ids, 500_000)

        def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            if not by_word:
                found = [np.frombuffer(x, kind) for x in raw(texts.to_pylist())]
                return np.concatenate([np.zeros(0, kind), *found]), np.array(list(map(len, found)), np.int64)
            lists = pc.ascii_split_whitespace(texts)
            words = lists.flatten().dictionary_encode()
            at = words.indices.to_numpy(zero_copy_only=False)
            found = memo.values(words.dictionary.to_pylist())
            size = np.array(list(map(len, found)), np.int64) // np.dtype(kind).itemsize
            data = np.frombuffer(b"".join(found), kind)
            starts = np.cumsum(size) - size
            ends = np.concatenate([[0], np.cumsum(size[at])])
            ids = np.empty(ends[-1], kind)
            for k in range(0, len(at), 500_000):  # in pieces, as the places take four times the ids' room
                part = at[k:k + 500_000]
                first, own = ends[k], size[part]
                shift = np.repeat(starts[part] - (ends[k:k + len(part)] - first), own)
                ids[first:first + len(shift)] = data[shift + np.arange(len(shift))]
            per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            return ids, np.diff(ends[np.concatenate([[0], np.cumsum(per_text)])])

        _ENCODERS[path] = encode, levels
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 2, shard_tokens: int = 1_000_000) -> DataFrame:
    """Encode, write the shards under ``out_dir``, return their manifest.

    Manifest: ``part`` and ``seq`` (their order is the ids' order), ``path``, ``n_docs``,
    ``n_tokens``, ``in_part`` (ids of the partition before this shard).
    """
    spark = docs.sparkSession
    out_dir = out_dir or scratch(spark, "tokens")
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .repartitionByRange("id").sortWithinPartitions("id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, levels = encoder(tokenizer_path)
        part, stamp = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        done = {"seq": 0, "in_part": 0}
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        lens: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            tokens, n = np.concatenate(ids), np.concatenate(lens)
            path = f"{out_dir}/{part:06d}-{done['seq']:06d}-{stamp}.twm"
            with open_out(path) as f:
                f.write(dump(tokens, levels, pa.table({"id": pa.concat_arrays(keys), "n": pa.array(n, pa.int64())})))
            row = pa.record_batch({"part": [part], "seq": [done["seq"]], "path": [path], "n_docs": [len(n)],
                                   "n_tokens": [len(tokens)], "in_part": [done["in_part"]]})
            done["seq"] += 1
            done["in_part"] += len(tokens)
            for x in (ids, keys, lens):
                x.clear()
            return row

        held = 0
        for b in batches:
            at = 0
            for run in chunks(pc.utf8_length(b.column("text")).to_pylist(), int, 32_000_000):
                found, n = encode(b.column("text").slice(at, len(run)))
                ends = np.cumsum(n)
                found = np.insert(found, ends, end_id)
                ends, n = ends + np.arange(1, len(n) + 1), n + 1
                first = 0
                while first < len(n):  # documents up to the one that fills the shard
                    start = int(ends[first] - n[first])
                    last = min(int(np.searchsorted(ends, start + shard_tokens - held)), len(n) - 1)
                    ids.append(found[start:int(ends[last])])
                    keys.append(b.column("id").slice(at + first, last + 1 - first))
                    lens.append(n[first:last + 1])
                    held += int(ends[last]) - start
                    first = last + 1
                    if held >= shard_tokens:
                        yield close()
                        held = 0
                at += len(run)
        if lens:
            yield close()

    schema = "part long, seq long, path string, n_docs long, n_tokens long, in_part long"
    return written(rows.mapInArrow(write, schema), "token-manifest")


def read_tokens(manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Read shards back: a row per document (``id, start, n_tokens, ids_crc32``).

    ``start`` counts the ids of all documents before it.  Only the partitions' totals reach the
    driver: one number for each partition of the writing job.
    """
    spark = manifest.sparkSession
    totals = sorted((r["part"], r["n"]) for r in
                    manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, at = [], 0
    for part, n in totals:
        starts.append((part, at))
        at += n
    base = spark.createDataFrame(starts, "part long, base long")
    todo = manifest.join(F.broadcast(base), "part").select("path", (F.col("base") + F.col("in_part")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with open_in(path) as f:
                    matrix, docs = load(f.read())
                ids = matrix.ids().astype("<u4")
                lens = docs.column("n").to_numpy()
                ends = np.cumsum(lens)
                crc = [zlib.crc32(ids[e - n:e]) for e, n in zip(ends.tolist(), lens.tolist())]
                yield pa.record_batch({"id": docs.column("id").combine_chunks(),
                                       "start": pa.array(start + ends - lens, pa.int64()),
                                       "n_tokens": pa.array(lens, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return todo.repartition(max(1, len(totals))).mapInArrow(
        read, f"id {id_type}, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as shards, read the files back, one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    return read_tokens(write_tokens(docs, tokenizer_path, id_col=id_col, text_col=text_col), kind) \
        .withColumnRenamed("id", id_col)
