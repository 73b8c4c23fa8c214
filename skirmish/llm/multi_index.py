"""Approximate nearest neighbours by an inverted multi-index.

The two halves of the vectors are quantised separately, each by k-means on a bounded sample. A pair of centroids, one of
either half, is a cell, and the index lists each cell's entries. A query orders the centroids of each half by their distance
(here: the largest inner product first) and traverses the pairs by summed distance with a heap, until the cells hold the
wanted share of the entries. The entries of those cells are reranked on the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import checkpoint, frame, lean
from skirmish.llm.vectors import batches_of, matrix, sampled, search, usable
from skirmish.session import share_code

CENTROIDS = 48  # of each half; at most 63
SAMPLE = 20_000  # the most vectors that codebooks are fitted on
SHARE = 0.55  # a query visits cells until they hold this share of the entries


def k_means(x: np.ndarray, k: int, rounds: int = 15, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy() if k else np.zeros((0, x.shape[1]))
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for j in range(k):
            if (near == j).any():
                c[j] = x[near == j].mean(axis=0)
    return c


def traverse(a: np.ndarray, b: np.ndarray, held: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Pairs (u, v) by falling a[u] + b[v], until the cells have `wanted` entries together; held: entries of each cell."""
    ua, vb = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap = [(-(a[ua[0]] + b[vb[0]]), 0, 0)]
    out, have = [], 0
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        u, v = int(ua[i]), int(vb[j])
        if held[u, v]:
            out.append((u, v))
            have += held[u, v]
        if j + 1 < len(vb):
            heapq.heappush(heap, (-(a[u] + b[vb[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(ua):
            heapq.heappush(heap, (-(a[ua[i + 1]] + b[vb[0]]), i + 1, 0))
    return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q @ x.T


def inner_in_order(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order wherever a vector stands, so equal vectors tie."""
    return np.add.accumulate(x * q, axis=1)[:, -1]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, centroids: int = CENTROIDS, share: float = SHARE, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k entries found with the largest inner product for each query.

    rows and queries: (vec_id, embedding). Vectors that are null, zero, or hold null or non-finite components take no part,
    nor do those of another length than most. Repeated rows are entries of their own. An empty table finds nothing.
    """
    share_code(rows.sparkSession)
    vectors = usable(rows, zeros=False)
    fit = sampled(vectors, sample)
    if not fit.size:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = fit.shape[1]
    half = dims // 2
    books = (k_means(fit[:, :half], centroids), k_means(fit[:, half:], centroids))
    shaped = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"))
            u, v = ((y @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1).astype(np.int32) for y, c in ((x[:, :half], books[0]), (x[:, half:], books[1])))
            yield frame({"grp": u, "cell": v, "vec_id": b.column("vec_id"), "v": b.column("v")}, shaped)

    index = checkpoint(vectors.where(F.size("v") == dims).mapInArrow(lean(assign), shaped))
    held = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["grp"], r["cell"]] = r["n"]
    wanted = max(k + 1, int(np.ceil(share * held.sum())))
    routed = T.StructType([T.StructField("grp", T.IntegerType()), T.StructField("cells", T.LongType()), T.StructField("query_id", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            x = matrix(b.column("v"))
            a, c = x[:, :half] @ books[0].T, x[:, half:] @ books[1].T
            at, groups, cells = [], [], []
            for r in range(len(x)):
                seen: dict[int, int] = {}
                for u, v in traverse(a[r], c[r], held, wanted):
                    seen[u] = seen.get(u, 0) | 1 << v
                at += [r] * len(seen)
                groups += seen
                cells += seen.values()
            take = pa.array(at, pa.int64())
            yield frame({"grp": np.array(groups, np.int32), "cells": np.array(cells, dtype=np.uint64).view(np.int64), "query_id": b.column("vec_id").take(take), "v": b.column("v").take(take)}, routed)

    def visited(q: pd.DataFrame, e: pd.DataFrame) -> np.ndarray:
        return (q["cells"].to_numpy()[:, None] >> e["cell"].to_numpy()[None, :]) & 1 == 1

    asked = usable(queries, zeros=False).where(F.size("v") == dims).mapInArrow(lean(route), routed)
    return search(index, asked, k, inner, visited, inner_in_order)


def nearest_documents(rows: DataFrame) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    return nearest(rows.select("vec_id", "embedding"), rows.where(F.col("vec_id") % 20 == 0).select("vec_id", "embedding"))
