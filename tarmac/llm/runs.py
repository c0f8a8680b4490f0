"""Running totals along a global order, without a window over a hot key.

Rows are range-partitioned and sorted by (key, order); every task runs its totals through its own rows.  A key
that spans partitions is mended by what the partitions before hold of it: two rows a partition reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import written


def segments(key: np.ndarray) -> np.ndarray:
    """Where a run of equal keys starts."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new)


def _run(x: np.ndarray, first: np.ndarray, carry: int, xor: bool) -> np.ndarray:
    """Totals within each run of rows; ``carry`` goes into the first run."""
    if not xor:
        total = np.cumsum(x)
        before = np.repeat(np.append(0, total[first[1:] - 1]), np.diff(np.append(first, len(x))))
        total -= before
        total[:first[1] if len(first) > 1 else len(x)] += carry
        return total
    total = np.bitwise_xor.accumulate(x)
    total ^= np.repeat(np.append(0, total[first[1:] - 1]), np.diff(np.append(first, len(x))))
    total[:first[1] if len(first) > 1 else len(x)] ^= carry
    return total


def running(df: DataFrame, key: str, order: list, add: tuple = (), xor: tuple = (), count: str = "place") -> DataFrame:
    """``df`` with ``count`` (from 1) and the columns ``add`` and ``xor`` replaced by totals within ``key`` up to the row.

    ``key`` and the totalled columns are longs without nulls.  Rows equal in key and order come in any order: give
    an order that tells them apart where it matters, and where one value may repeat without bound.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(count, T.LongType()), T.StructField("_part", T.IntegerType()),
                           T.StructField("_edge", T.BooleanType())])
    values, own, names = [count, *add, *xor], df.columns, schema.names

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, last, carry, first_key = None, None, dict.fromkeys(values, 0), None

        def out(b: pa.RecordBatch, following) -> pa.RecordBatch:
            nonlocal last, carry, first_key
            k = b.column(key).to_numpy(zero_copy_only=False)
            first = segments(k)
            if last is None:
                first_key = int(k[0])
            elif int(k[0]) != last:
                carry = dict.fromkeys(values, 0)
            got = {}
            for name in values:
                x = np.ones(len(k), np.int64) if name == count else b.column(name).to_numpy(zero_copy_only=False)
                got[name] = _run(x, first, carry[name], name in xor)
            last, carry = int(k[-1]), {name: int(got[name][-1]) for name in values}
            ends = np.append(first[1:], len(k)) - 1
            edge = np.zeros(len(k), bool)
            edge[ends[k[ends] == first_key]] = True
            edge[-1] = following is None or (edge[-1] and int(following.column(key)[0].as_py()) != last)
            cols = [pa.array(got[c]) if c in got else b.column(c) for c in own]
            return pa.record_batch([*cols, pa.array(got[count]), pa.array(np.full(len(k), part, np.int32)), pa.array(edge)], names)

        for b in batches:
            if b.num_rows:
                if held is not None:
                    yield out(held, b)
                held = b
        if held is not None:
            yield out(held, None)

    local = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(accumulate, schema), "running")
    edges: dict[int, list] = {}
    for r in local.where("_edge").select("_part", key, *values).orderBy("_part", key).collect():
        edges.setdefault(r["_part"], []).append(r)
    spans, before = [], None
    for part in sorted(edges):
        head, tail = edges[part][0], edges[part][-1]
        mine = {v: tail[v] for v in values}
        if before is not None and head[key] == before[0]:
            spans.append((part, head[key], *(before[1][v] for v in values)))
            if tail[key] == head[key]:
                mine = {v: tail[v] ^ before[1][v] if v in xor else tail[v] + before[1][v] for v in values}
        before = (tail[key], mine)
    if not spans:
        return local.drop("_part", "_edge")
    small = df.sparkSession.createDataFrame(spans, ", ".join(["_part int", "_key long", *(f"_{v} long" for v in values)]))
    rows = local.join(F.broadcast(small.withColumnRenamed("_part", "_of")), (F.col("_part") == F.col("_of")) & (F.col(key) == F.col("_key")), "left")
    now = {v: F.coalesce(F.col(v).bitwiseXOR(F.col(f"_{v}")) if v in xor else F.col(v) + F.col(f"_{v}"), F.col(v)) for v in values}
    return rows.withColumns(now).select(*df.columns, count)
