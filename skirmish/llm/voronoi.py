"""Exact top-k by inner product: a Voronoi kNN join.

Pivots, a bounded sample of the data, divide data and queries into Voronoi cells. Each cell of the data is summarised by its
size, the largest distance of its members from the pivot, and their largest norm. For a query q and a member x of the cell
of pivot p, q.x = q.p + q.(x - p) is at most q.p + |q| |x - p|. A first round solves each query in the cells that promise most
until they hold k others; its k-th score bounds the rest: in a second round a query goes only to cells whose bound reaches
that score, and there meets only members close enough to the surface to reach it. Each group is solved locally and exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import checkpoint, frame, lean
from skirmish.llm.vectors import batches_of, matrix, sampled, search, usable
from skirmish.session import share_code

PIVOTS = 64
SAMPLE = 5_000  # the most vectors that pivots are chosen from
SLACK = 1e-9  # relative room for rounding in the bounds, which are never used as scores


def pivots_of(x: np.ndarray, n: int, seed: int = 3) -> np.ndarray:
    """n spread-out vectors: each next one is drawn with a chance that grows with its squared distance from those before."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.sum() > 0:
        chosen.append(int(rng.choice(len(x), p=far / far.sum())))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as doubles where those hold them exactly."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return q @ x.T
    return np.array([[float(int(a)) for a in r] for r in q.astype(object) @ x.astype(object).T])


def top(rows: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best by the inner product of floor(scale x component).

    rows and queries: (vec_id, embedding). Vectors that are null or hold null or non-finite components take no part, nor do
    those of another length than most. Zero vectors count, with score 0. Repeated rows are entries of their own.
    """
    share_code(rows.sparkSession)
    whole = lambda df: usable(df, zeros=True).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    vectors = whole(rows)
    fit = sampled(vectors, sample)
    if not fit.size:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = fit.shape[1]
    p = pivots_of(fit, pivots)
    half_norm = 0.5 * (p * p).sum(axis=1)
    cells = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("far", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            x = matrix(b.column("v"))
            grp = (x @ p.T - half_norm).argmax(axis=1)
            far = np.sqrt(((x - p[grp]) ** 2).sum(axis=1)) * (1 + SLACK)
            yield frame({"grp": grp.astype(np.int32), "vec_id": b.column("vec_id"), "far": far, "v": b.column("v")}, cells)

    data = checkpoint(vectors.where(F.size("v") == dims).mapInArrow(lean(assign), cells))
    size, radius = np.zeros(len(p), np.int64), np.zeros(len(p))
    for r in data.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():
        size[r["grp"]], radius[r["grp"]] = r["n"], r["r"]
    asked = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("query_id", T.LongType()), T.StructField("at_least", T.DoubleType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def router(second: bool):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches_of(batches):
                x = matrix(b.column("v"))
                near = x @ p.T
                norm = np.sqrt((x * x).sum(axis=1))
                reach = near + norm[:, None] * radius[None, :]
                reach += SLACK * (np.abs(near) + norm[:, None] * radius[None, :] + 1)
                if second:
                    floor = b.column("floor").to_numpy(zero_copy_only=False)
                    go = (reach >= floor[:, None]) & (size > 0)
                    go &= ~np.array([np.isin(np.arange(len(p)), s) for s in b.column("seen").to_pylist()])
                else:
                    floor = np.full(len(x), -np.inf)
                    order = np.argsort(-near, axis=1, kind="stable")
                    before = np.cumsum(size[order], axis=1) - size[order]
                    go = np.zeros_like(near, bool)
                    np.put_along_axis(go, order, before <= k, axis=1)  # k others, besides perhaps the query itself
                    go &= size > 0
                at, grp = np.nonzero(go)
                take = pa.array(at)
                yield frame({"grp": grp.astype(np.int32), "query_id": b.column("vec_id").take(take), "at_least": floor[at], "v": b.column("v").take(take)}, asked)

        return route

    def reachable(q: pd.DataFrame, e: pd.DataFrame) -> np.ndarray:
        at = p[int(q["grp"].iloc[0])]
        y = np.array(q["v"].tolist())
        near, norm = y @ at, np.sqrt((y * y).sum(axis=1))
        reach = norm[:, None] * e["far"].to_numpy()[None, :]
        return near[:, None] + reach + SLACK * (np.abs(near)[:, None] + reach + 1) >= q["at_least"].to_numpy()[:, None]

    wanted = whole(queries).where(F.size("v") == dims)
    first = wanted.mapInArrow(router(False), asked)
    found = checkpoint(search(data, first, k, products))
    floor = found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("floor")).otherwise(F.lit(float("-inf"))).alias("floor"))
    seen = first.groupBy("query_id").agg(F.collect_set("grp").alias("seen"))
    bounded = wanted.withColumnRenamed("vec_id", "query_id").join(floor, "query_id", "left").join(seen, "query_id", "left")
    bounded = bounded.select(F.col("query_id").alias("vec_id"), "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"), F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))
    more = search(data, bounded.mapInArrow(router(True), asked), k, products, reachable)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    every = found.drop("rank").unionByName(more.drop("rank")).withColumn("rank", F.row_number().over(best))
    return every.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))


def top_documents(rows: DataFrame) -> DataFrame:
    """The 5 best of every vector whose id is divisible by 50, among all others."""
    return top(rows.select("vec_id", "embedding"), rows.where(F.col("vec_id") % 50 == 0).select("vec_id", "embedding"))
