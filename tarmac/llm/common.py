"""Helpers shared by the operators of this subpackage.

Files that tasks write themselves (token shards, WARC archives) go to the folder that the session
names in ``spark.checkpoint.dir``.  They are opened through ``pyarrow.fs``, so any store with a
pyarrow file system works.  A task writes under a name of its own attempt and reports it in its
result, so a task that runs twice leaves an unused file and never a half-written one in use.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared folder."""
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back with its own schema; cuts the lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uri(path: str) -> str:
    """The form of a path that pyarrow takes: ``file:/x`` and ``/x`` become ``file:///x``."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[5:]
    return "file://" + path if path.startswith("/") else path


def open_out(path: str):
    """A binary output stream at ``path``; makes the folder."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri(path))
    store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(inner)


def open_in(path: str):
    """A binary input stream of ``path``."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(uri(path))
    return store.open_input_stream(inner)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def small(batches: Iterator, rows: int = 1_000) -> Iterator:
    """The batches in slices of ``rows``, so that their texts are Python strings a few at a time."""
    for b in batches:
        for k in range(0, max(1, b.num_rows), rows):
            yield b.slice(k, rows)


class WordMemo:
    """Bounded memo of a pure function of a word, kept by a worker between batches.

    ``fill(words)`` gives the values of a list of words.  Two generations of about ``size`` entries
    hold the memory down: when the young one is full it becomes the old one.  Words over
    ``longest`` characters are forgotten after their batch.
    """

    def __init__(self, fill, size: int = 250_000, longest: int = 48):
        self.fill, self.size, self.longest = fill, size, longest
        self.young: dict = {}
        self.old: dict = {}
        self.large: list = []

    def values(self, words: list) -> list:
        """The values of ``words``, in their order."""
        for w in self.large:
            self.young.pop(w, None)
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = list(map(young.get, words))
        todo = {w for w, v in zip(words, out) if v is None}
        if not todo:
            return out
        for w in todo & old.keys():
            young[w] = old[w]
        missing = [w for w in todo if w not in young]
        self.large = [w for w in missing if len(w) > self.longest]
        if missing:
            young.update(zip(missing, self.fill(missing)))
        return [young[w] if v is None else v for w, v in zip(words, out)]

    def joined(self, lists: list[list]) -> list[bytes]:
        """For each list of words, their values (bytes) joined."""
        found = self.values([w for words in lists for w in words])
        ends = list(itertools.accumulate(map(len, lists)))
        return [b"".join(found[e - len(words):e]) for e, words in zip(ends, lists)]


def chunks(items: list, weight, limit: int) -> Iterator[list]:
    """Runs of ``items`` whose weights sum to about ``limit`` at most; one item at least."""
    run, total = [], 0
    for x in items:
        w = weight(x)
        if run and total + w > limit:
            yield run
            run, total = [], 0
        run.append(x)
        total += w
    if run:
        yield run
