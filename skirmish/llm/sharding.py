"""K-d tree sharding: nodes split at weighted medians along their widest metadata dimension.

Each cut is found by narrowing an interval: every pass counts bytes in at most BINS intervals of each node, on the
executors, and the driver sees those sums only. A cut is a point in the order (dimension, ties, row), so that ties in a
dimension are divided too.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.llm.common import checkpoint, hash_key, numbered

BINS = 1024
WHOLE = 0.002  # of a shard's bytes: groups of equal texts up to that are not divided


@dataclass
class Node:
    leaves: int
    path: tuple[int, ...] = ()
    weight: int = 0
    dim: str = ""
    order: list[str] = field(default_factory=list)
    fixed: list[int] = field(default_factory=list)
    lo: int = 0
    hi: int = -1
    below: int = 0
    target: float = 0
    cut: tuple[list[int], int] | None = None  # rows whose order values are below (fixed..., value) go left


def _left(node: Node) -> Column:
    fixed, value = node.cut
    less = F.col(node.order[len(fixed)]) < F.lit(value)
    for name, v in reversed(list(zip(node.order, fixed, strict=False))):
        less = (F.col(name) < F.lit(v)) | ((F.col(name) == F.lit(v)) & less)
    return less


def kd_shards(rows: DataFrame, dims: list[str], weight: str, leaves: int | None = None, target_bytes: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with a column `shard`, 0 to leaves - 1, whose weights are as near equal as single rows allow.

    rows: narrow; dims, weight and ties are non-null integer columns. Either the number of leaves or the bytes that a leaf
    should have are given; a node for n leaves is split at the weight n // 2 : n - n // 2. An empty table has no shards.
    """
    base = checkpoint(rows.withColumn("_row", F.monotonically_increasing_id()))
    names = list(dict.fromkeys([*dims, *ties, "_row"]))
    span = base.agg(F.sum(weight).alias("w"), *(f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max)))).first()
    if not span["w"]:
        return base.withColumn("shard", F.lit(0)).drop("_row")
    count = leaves or max(1, -(-span["w"] // target_bytes))
    width = {c: max(1, span[f"hi_{c}"] - span[f"lo_{c}"]) for c in dims}
    done: list[Node] = []
    level = [Node(count)]
    tree: dict[tuple[int, ...], Node] = {(): level[0]}

    def number(nodes: list[Node]) -> Column:
        """The index in nodes of a row's node, or null."""

        def under(path: tuple[int, ...], at: int = 0) -> Column:
            for i, n in enumerate(nodes):
                if n.path == path:
                    return F.lit(i)
            n = tree.get(path)
            if n is None or n.cut is None:
                return F.lit(None).cast("int")
            return F.when(_left(n), under((*path, 0))).otherwise(under((*path, 1)))

        return under(())

    while level:
        level = [n for n in level if n.leaves > 1 or done.append(n)]
        if not level:
            break
        at = {r["n"]: r for r in base.groupBy(number(level).alias("n")).agg(F.sum(weight).alias("w"), *(f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max)))).collect()}
        for i, n in enumerate(level):
            r = at.get(i)
            if r is None:  # no rows: its leaves stay empty
                n.cut, n.order = ([], 0), ["_row"]
                continue
            n.weight = r["w"]
            n.dim = max(dims, key=lambda c: (r[f"hi_{c}"] - r[f"lo_{c}"]) / width[c])
            n.order = list(dict.fromkeys([n.dim, *ties, "_row"]))
            n.lo, n.hi, n.target = r[f"lo_{n.dim}"], r[f"hi_{n.dim}"], n.weight * (n.leaves // 2) / n.leaves
        bounds = at
        while any(n.cut is None for n in level):
            key = F.lit(None).cast("long")
            node = number(level)
            for i, n in enumerate(level):
                if n.cut is None:
                    step = -(-(n.hi - n.lo + 1) // BINS)
                    c = F.col(n.order[len(n.fixed)])
                    here = (node == i) & c.between(n.lo, n.hi)
                    for name, v in zip(n.order, n.fixed, strict=False):
                        here &= F.col(name) == v
                    key = F.when(here, F.lit(i * BINS).cast("long") + F.call_function("div", c - F.lit(n.lo), F.lit(step))).otherwise(key)
            sums: dict[int, list] = {}
            for r in base.select(key.alias("k"), F.col(weight).alias("w")).where("k IS NOT NULL").groupBy("k").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).collect():
                sums.setdefault(r["k"] // BINS, []).append((r["k"] % BINS, r["w"], r["n"]))
            for i, n in enumerate(level):
                if n.cut is not None:
                    continue
                step = -(-(n.hi - n.lo + 1) // BINS)
                below = n.below
                for b, w, rows_in in sorted(sums[i]):
                    if below + w >= n.target:
                        break
                    below += w
                first = n.lo + b * step
                if rows_in == 1 or (step == 1 and len(n.fixed) + 1 == len(n.order)):
                    after = n.target - below > below + w - n.target  # the nearer side of the row
                    n.cut = (n.fixed, first + step if after else first)
                else:
                    n.below = below
                    n.lo, n.hi = first, first + step - 1
                    if step == 1:
                        n.fixed = [*n.fixed, first]
                        name = n.order[len(n.fixed)]
                        n.lo, n.hi = bounds[i][f"lo_{name}"], bounds[i][f"hi_{name}"]
        following = []
        for n in level:
            for side, leaves_in in ((0, n.leaves // 2), (1, n.leaves - n.leaves // 2)):
                child = Node(leaves_in, (*n.path, side))
                tree[child.path] = child
                following.append(child)
        level = following
    return base.withColumn("shard", number(sorted(done, key=lambda n: n.path))).drop("_row")


def _codes(rows: DataFrame, *columns: str) -> dict[str, Column]:
    """Whole numbers in the order of text columns: six bytes after what all values begin with. A null comes first."""
    ends = rows.agg(*(f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max)))).first()
    out = {}
    for c in columns:
        same = os.path.commonprefix([(ends[f"{k}_{c}"] or "").encode() for k in ("lo", "hi")])
        part = F.hex(F.substring(F.col(c).cast("binary"), len(same) + 1, 6))
        out[c] = F.coalesce(F.conv(F.rpad(part, 12, "0"), 16, 10).cast("long"), F.lit(-1))
    return out


def shard_documents(docs: DataFrame, shards: int = 8, whole: float = WHOLE) -> DataFrame:
    """Every document with its shard by equal bytes, and its place in the shard.

    The dimensions are metadata: doc_id, source, lang and size. Documents with equal texts have the least of their metadata
    and neighbour each other, so each of the shards - 1 cuts passes through one such group at most; and a group whose bytes
    are no more than the part `whole` of a shard's isn't divided, which shards' sizes may then differ by. A null text has
    no bytes and counts as size 1; null metadata sorts first; repeated rows are documents with equal texts. Long texts are
    one row like others. An empty table has no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    k1, k2 = hash_key(text)
    codes = _codes(docs, "lang", "source")
    rows = checkpoint(docs.select(
        F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), k1, k2,
        F.coalesce("doc_id", F.lit(-(1 << 61))).cast("long").alias("_doc"), *(x.alias(f"_{c}") for c, x in codes.items()), F.monotonically_increasing_id().alias("_at")))
    share = max(1, (rows.agg(F.sum("size")).first()[0] or 0) // shards)
    named = ("_doc", "_lang", "_source")
    heavy = rows.groupBy("k1", "k2").agg(F.sum("size").alias("w"), *(F.min(c).alias(f"{c}_of") for c in named)).where(F.col("w") > whole * share).drop("w")
    dealt = rows.join(F.broadcast(heavy), ["k1", "k2"], "left")  # fewer than (shards + 1) / whole groups
    dealt = dealt.withColumn("_piece", F.when(F.col("_doc_of").isNotNull(), F.col("_at")).otherwise(0)).withColumns({c: F.coalesce(f"{c}_of", c) for c in named})
    unit = ["k1", "k2", "_piece"]
    units = dealt.groupBy(*unit).agg(F.sum("size").alias("weight"), *(F.min(c).alias(c) for c in ("size", *named)))
    units = units.withColumn("_text", F.shiftrightunsigned("k1", 2))
    sharded = kd_shards(units, ["_doc", "_source", "_lang", "size"], "weight", leaves=shards, ties=("_text", "_piece"))
    placed = numbered(dealt.join(sharded.select(*unit, "shard"), unit).select("doc_id", "size", "text_crc32", "shard"), "shard", rank="slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
