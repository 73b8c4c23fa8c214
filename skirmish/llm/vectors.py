"""What vector searches share: usable vectors, a bounded sample, and exact scoring of routed blocks.

A search routes queries to groups of entries; how it finds the groups is its own affair. Here the groups are divided into
blocks of bounded size, so that a group may hold any share of the rows: entries are dealt by hash over the blocks of their
group, and a query goes to every block of its groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, QUERIES = 4096, 1024  # entries and queries that meet in one task at once
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def usable(rows: DataFrame, zeros: bool, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of rows with an id and a vector of finite doubles only; zero vectors if wanted. Repeated rows stay."""
    v = F.col(vector).cast("array<double>")
    largest = 1.7976931348623157e308
    good = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall("v", lambda x: x.isNotNull() & x.between(-largest, largest))
    some = rows.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"), F.col(vector)).where(F.col("vec_id").isNotNull() & good)
    if not zeros:
        some = some.where(F.exists("v", lambda x: x != 0))
    return some.select("vec_id", "v")


def sampled(rows: DataFrame, most: int) -> np.ndarray:
    """About `most` vectors, all if there are fewer, chosen by a hash of their ids; those of the commonest length."""
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    grain = 1 << 24
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(grain)) < min(grain, -(-grain * most // n))).limit(2 * most)
    pdf = some.toPandas().sort_values("vec_id")
    sizes = pdf["v"].map(len)
    return np.array(pdf["v"][sizes == sizes.mode().iloc[0]].tolist(), dtype=np.float64) if len(pdf) else np.zeros((0, 0))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix; all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(entries: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray], narrowed: Callable | None = None, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best entries in the groups it is routed to, ties to smaller ids.

    entries: (grp, vec_id, v, ...); queries: (grp, query_id, v, ...), one row for each group of a query. score gives a matrix
    of queries by entries; narrowed(query frame, entry frame) may give a mask of the pairs to score. Own rows don't count.
    With exact, score only chooses candidates, with room for rounding, and exact(query, entries) gives what is returned.
    """
    sizes = entries.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    asks = queries.groupBy("grp").agg(F.count(F.lit(1)).alias("m"))
    plan = sizes.join(asks, "grp").select("grp", F.call_function("div", F.col("n") + (BLOCK - 1), F.lit(BLOCK)).alias("p"), F.call_function("div", F.col("m") + (QUERIES - 1), F.lit(QUERIES)).alias("q"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = entries.join(plan, "grp").withColumn("i", F.pmod(F.xxhash64("vec_id", F.lit(3)), "p")).withColumn("j", each("q")).drop("p", "q")
    right = queries.join(plan, "grp").withColumn("j", F.pmod(F.xxhash64("query_id", F.lit(4)), "q")).withColumn("i", each("p")).drop("p", "q")
    keys = ["grp", "i", "j"]

    def meet(e: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if e.empty or q.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        e = e.sort_values("vec_id", kind="stable").reset_index(drop=True)
        x, y = np.array(e["v"].tolist()), np.array(q["v"].tolist())
        ids, own = e["vec_id"].to_numpy(), q["query_id"].to_numpy()
        values = score(y, x)
        may = own[:, None] != ids[None, :]
        if narrowed:
            may &= narrowed(q, e)
        out = []
        for r in range(len(y)):
            at = np.flatnonzero(may[r])
            s = values[r, at]
            if len(at) > k:
                s0 = np.partition(s, len(s) - k)[len(s) - k]
                s0 -= 1e-9 * (abs(s0) + 1) if exact else 0
                at, s = at[s >= s0], s[s >= s0]
            if exact:
                s = exact(y[r], x[at])
            best = np.argsort(-s, kind="stable")[:k]  # ids ascend, so ties go to smaller ones
            out.append(pd.DataFrame({"query_id": own[r], "vec_id": ids[at[best]], "score": s[best]}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def batches_of(rows: Iterator[pa.RecordBatch], most: int = 2048) -> Iterator[pa.RecordBatch]:
    for b in rows:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)
