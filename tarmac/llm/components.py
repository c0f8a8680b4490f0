"""Connected components of a link table, without gathering it anywhere.

Links are dealt out in tasks of ``TASK_LINKS`` and contracted within each; few links are done then.  Else large-star and small-star steps alternate until the links no longer
change.  A node's smallest neighbour is a partial minimum; it is written and joined back to the node's links, by broadcast while
there are few nodes (counted), else by a join of two written tables, which the skew join splits where a hub has a
third of all links.  Each round's links are written to the shared folder.

Cases: a link of a node with itself is no link; repeated links count once; nulls are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import written

#: At most so many ids (of classes, documents, nodes or tiles; 24 bytes each or less) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


#: Links that a task contracts by itself.
TASK_LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within one task, links of each node to the smallest node it reaches there."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            x, y = find(u), find(v)
            if x != y:
                parent[max(x, y)] = min(x, y)
    out = [(x, find(x)) for x in parent]
    out = [(x, r) for x, r in out if x != r]
    yield pa.record_batch({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([r for _, r in out], pa.int64())})


def few(df: DataFrame) -> DataFrame:
    """``df`` (written) marked for a broadcast if it has at most ``BROADCAST_IDS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``u, v``, longs); the root is the smallest node."""
    links = links.select("u", "v").where("u <> v")
    tasks = 1 + links.count() // TASK_LINKS
    edges = written(links.repartition(tasks).mapInArrow(_forest, "u long, v long"), "cc-links")
    before = None
    while tasks > 1:  # one task's links are contracted already
        # Large star: every neighbour above a node is tied to the smallest one around the node.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
        large = written(both.where("v > u").join(few(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .where("u <> v").distinct(), "cc-large")
        # Small star: every node's smaller neighbours, and the node, are tied to the smallest of them.
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(few(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "cc-links")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    # Every node but the roots is tied to its root now.
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    tops = edges.select(F.col("v").alias("node")).distinct()
    return written(roots.unionByName(tops.select("node", F.col("node").alias("root"))), "cc-roots")


def document_components(every: DataFrame, first_doc: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``id, n, component_id`` of every document of ``every`` (``id, n, sid``).

    ``first_doc`` has the smallest ``id`` of every class ``sid``, ``roots`` the components of the classes (``node, root``; None: no link).
    """
    if roots is None:
        classes = first_doc.select("sid", F.col("id").alias("component_id"))
    else:
        rooted = first_doc.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
        classes = rooted.join(least, "root").select("sid", "component_id")
    return every.join(classes, "sid", "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))
