"""Union by name and keep-first de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(frames, tag_col: str | None = None, tags=None) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become null.

    With ``tag_col``, each input gets a literal tag first (the split name).
    """
    frames = list(frames)
    if tag_col is not None:
        frames = [f.withColumn(tag_col, F.lit(t)) for f, t in zip(frames, tags)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order`` tuple (R2).

    ``dropDuplicates`` keeps an arbitrary row; here "first" is a total order
    given by the caller.  ``min(struct(order..., rest...))`` is a partial
    aggregate, so a hot key is combined map-side instead of sorted in one task.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    m = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_first")
    return df.groupBy(*keys).agg(m).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in order + rest])
