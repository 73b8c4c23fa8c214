"""Connected components of a distributed edge table, without collecting any of it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import checkpoint, frame, lean, spread

EDGES = 100_000  # edges of a partition
STAR = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges but the least of its component, and that least one."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # roots hang below smaller roots only
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(ids))
    return ids[below], ids[root[below]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v) with those of each partition as stars: they connect the same vertices, and are no more."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if parts:
            u, v = stars(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield frame({"u": u, "v": v}, STAR)

    return edges.mapInArrow(lean(read), STAR)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, comp) for every vertex of the edges (a, b); comp is the least id that it reaches.

    Each partition of about EDGES edges first makes stars of its own edges. Where that are all, it is done; else alternating
    large-star and small-star steps re-hang neighbours on the least one known, and partitions contract their edges again, so
    the edges become stars in a number of rounds that grows with the logarithm of the size. Hot vertices are pre-aggregated
    before each shuffle. Edges are checkpointed each round; a component that has become a star costs its number of edges and
    no more. Edges are stars when no vertex hangs below two others, or below one that hangs itself. Where most_rounds do not
    suffice, it raises instead of returning what is not yet true. A vertex whose only edges lead to itself is none.
    """
    given = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    parts = lambda n: max(1, -(-n // EDGES))
    now = parts(given.count())
    e = checkpoint(_contracted(spread(given, now)))
    for _ in range(most_rounds):
        if now == 1:  # one partition has seen all edges
            break
        hung = e.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(False).alias("above")).union(e.select("v", F.lit(0), F.lit(True)))
        if hung.groupBy("x").agg(F.sum("below").alias("n"), F.max("above").alias("up")).where("n > 1 OR (n > 0 AND up)").isEmpty():
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v")  # each vertex hangs below smaller ones only
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        given = checkpoint(_contracted(small.union(least.select("u", F.col("m").alias("v"))).distinct()))
        now = parts(given.count())
        e = checkpoint(_contracted(spread(given, now)))
    else:
        raise RuntimeError(f"components: edges still change after {most_rounds} rounds")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(roots)
