"""Near-duplicates by a chosen-path similarity join over minwise tokens.

Documents with equal shingle sets form one class at once. Each class has a signature of minwise tokens. Several independent
trees branch the classes: a node chooses some positions of the signature, and a class goes down to one child for each, the
child of its token there. Similar classes share most tokens, so they meet again in a child with a probability near 1, while
others part. Nodes of at most SMALL classes are compared exhaustively by signature. Larger nodes are branched again, unless
all their classes are already connected, or most of them are, in which case branching cannot part them: there the rest is
compared with all, block by block. Candidates are confirmed on the full shingle sets.

Near copies come in large groups, whose pairs would be too many. So a node first proposes only a maximum spanning forest of
its likely pairs; when those are confirmed and connected, it proposes the likely pairs between different components.
With the defaults, a pair at the threshold misses all trees with a probability below one in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import checkpoint, frame, hash_key, lean, mix64, set_aside, sieve, slices, utf8
from skirmish.llm.graph import components
from skirmish.llm.shingles import by_chunk
from skirmish.session import share_code

TOKENS = 64  # of a signature
TREES, CHOSEN = 4, 4  # independent trees, positions that a node chooses
SMALL = 1024  # classes of a node, and of either side of a block, that are compared exhaustively
DEPTH = 3  # levels of branching before blocks of a node are compared
LIKELY = 36  # equal tokens of TOKENS that make a candidate: nearly five standard deviations below the threshold 0.8
ROWS = 4096  # documents for each partition of the join's own tables
DENSE = 0.5  # share of one component in a node beyond which branching cannot part it

_L = T.LongType()
SETS = T.StructType([T.StructField("doc_id", _L), T.StructField("_doc", _L), T.StructField("k1", _L), T.StructField("k2", _L), T.StructField("n_shingles", _L), T.StructField("h1", _L), T.StructField("h2", _L), T.StructField("sig", T.BinaryType())])
PAIRS = T.StructType([T.StructField("a", _L), T.StructField("b", _L)])
MEMBERS = T.StructType([T.StructField("key", _L), T.StructField("cid", _L), T.StructField("comp", _L), T.StructField("side", T.IntegerType()), T.StructField("members", _L)])
NODES = T.StructType([T.StructField("key", _L), T.StructField("cid", _L)])
_MULTIPLIERS = mix64(np.arange(TOKENS, dtype=np.uint64), 77) | np.uint64(1)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set hash and signature of each document, with two hashes of its text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = utf8(batch.column("text"))
            n = len(offsets) - 1
            size, h1, h2 = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sig = np.zeros((n, TOKENS), np.uint32)
            for i, j, s, at in by_chunk(raw, offsets, width):
                size[i:j] = np.diff(at)
                some = i + np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                starts = at[:-1][some - i]
                with np.errstate(over="ignore"):
                    h1[some], h2[some] = np.add.reduceat(mix64(s, 21), starts), np.add.reduceat(mix64(s, 22), starts)
                    for k in range(TOKENS):
                        sig[some, k] = np.minimum.reduceat(s * _MULTIPLIERS[k], starts) >> np.uint64(32)
            values = {c: batch.column(c) for c in ("doc_id", "_doc", "k1", "k2")}
            yield frame({**values, "n_shingles": size, "h1": signed(h1), "h2": signed(h2), "sig": pa.array([r.tobytes() for r in sig], pa.binary())}, SETS)

    return docs.select("doc_id", "_doc", "k1", "k2", "text").mapInArrow(lean(read), SETS)


def _tokens(column: pa.Array) -> np.ndarray:
    raw, _ = utf8(column)
    return np.frombuffer(raw.tobytes(), np.uint32).reshape(-1, TOKENS)


def offsets_of(key: np.ndarray) -> np.ndarray:
    """The first position of the nodes below the roots; it depends on the node's key alone."""
    return (mix64(key, 31) % np.uint64(TOKENS // CHOSEN)).astype(np.int64)


def root_offset(tree: int) -> int:
    """The first position of a tree's root: each tree has its own part of the offsets, and takes one there by hash."""
    part = TOKENS // CHOSEN // TREES
    return tree * part + int(mix64(np.array([tree], np.uint64), 51)[0] % np.uint64(part))


def positions(offset: np.ndarray) -> Iterator[np.ndarray]:
    """The positions that nodes with such first positions choose."""
    for c in range(CHOSEN):
        yield offset + c * (TOKENS // CHOSEN)


def _children(key: np.ndarray, sig: np.ndarray, offset: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of the children that each row goes down to."""
    for c, position in enumerate(positions(offset)):
        token = sig[np.arange(len(key)), position].astype(np.uint64)
        yield mix64(mix64(key, 40 + c) ^ token, 3)


def _branch(rows: DataFrame, roots: bool) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, cid = _tokens(batch.column("sig")), batch.column("cid")
            if roots:
                nodes = [(mix64(np.full(len(sig), t, np.uint64), 50), np.full(len(sig), root_offset(t))) for t in range(TREES)]
            else:
                key = batch.column("key").to_numpy().view(np.uint64)
                nodes = [(key, offsets_of(key))]
            for key, offset in nodes:
                for child in _children(key, sig, offset):
                    yield frame({"key": signed(child), "cid": cid}, NODES)

    return rows.mapInArrow(lean(emit), NODES)


def _groups(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(key, columns...) of each run of equal keys; rows come sorted by key. Signatures come as a matrix, texts as a list."""
    held: list[tuple] = []

    def run() -> tuple:
        key, *cols = zip(*held, strict=True)
        return (key[0], *(np.concatenate(x) if isinstance(x[0], np.ndarray) else [v for part in x for v in part] for x in cols))

    for batch in batches:
        key = batch.column("key").to_numpy()
        parts = [_tokens(batch.column(c)) if c == "sig" else batch.column(c).to_pylist() if c == "text" else batch.column(c).to_numpy() for c in columns]
        cuts = np.flatnonzero(np.diff(key)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(key)], strict=True):
            if held and i < j and held[0][0] != key[i]:
                yield run()
                held = []
            if i < j:
                held.append((key[i], *(p[i:j] for p in parts)))
    if held:
        yield run()


def _equal(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for k in range(TOKENS):
        out += (sig[:, k][:, None] == sig[:, k][None, :]).view(np.uint8)
    return out


def _forest(sig: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a maximum spanning forest over the likely pairs."""
    n = len(sig)
    like = _equal(sig)
    best, parent, out = np.full(n, -1, np.int16), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        v = int(np.argmax(np.where(out, best, -2)))
        out[v] = False
        if best[v] >= LIKELY:
            yield parent[v], v
        better = out & (like[v] > best)
        best[better], parent[better] = like[v][better], v


def _by_key(rows: DataFrame, parts: int, *columns: str) -> DataFrame:
    """The columns with runs of equal keys, in at most so many partitions."""
    return rows.select("key", *columns).coalesce(parts).repartition("key").sortWithinPartitions("key").coalesce(parts)


def _propose(rows: DataFrame, parts: int) -> DataFrame:
    """A maximum spanning forest of the likely pairs in each run of equal keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cid, sig in _groups(batches, "cid", "sig"):
            edges = np.array(list(_forest(sig)), dtype=np.int64).reshape(-1, 2)
            if len(edges):
                yield frame({"a": cid[edges].min(axis=1), "b": cid[edges].max(axis=1)}, PAIRS)

    return _by_key(rows, parts, "cid", "sig").mapInArrow(lean(emit), PAIRS)


def _apart(comp: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Pairs in different components and, where blocks of the rest meet blocks of all, on different sides."""
    may = comp[:, None] != comp[None, :]
    return may & (side[:, None] != side[None, :]) if side.max() > 0 else may


def _involved(rows: DataFrame, parts: int) -> DataFrame:
    """The rows that have a likely partner in another component, in their run of equal keys."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, cid, comp, side, sig in _groups(batches, "cid", "comp", "side", "sig"):
            at = np.flatnonzero((_apart(comp, side) & (_equal(sig) >= LIKELY)).any(axis=1))
            if len(at):
                members = np.bitwise_xor.reduce(mix64(cid[at].view(np.uint64), 90) ^ side[at].astype(np.uint64))
                yield frame({"key": np.full(len(at), key), "cid": cid[at], "comp": comp[at], "side": side[at], "members": np.full(len(at), members, np.uint64).view(np.int64)}, MEMBERS)

    return _by_key(rows, parts, "cid", "comp", "side", "sig").mapInArrow(lean(emit), MEMBERS)


def common_sizes(sets: np.ndarray, bounds: np.ndarray, columns: int = 4096) -> np.ndarray:
    """The sizes of all sets' intersections, from their incidence matrix in blocks of columns."""
    _, column = np.unique(sets, return_inverse=True)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(bounds) - 1, len(bounds) - 1), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        i, j = np.searchsorted(column, [lo, lo + columns])
        m = np.zeros((len(out), columns), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _settle(rows: DataFrame, parts: int, width: int, threshold: int) -> DataFrame:
    """Links between components in each run of equal keys: all pairs are checked on their full sets, and a spanning forest of
    the links found is returned."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cid, comp, side, texts in _groups(batches, "cid", "comp", "side", "text"):
            raw, offsets = utf8(pa.array(texts, pa.large_string()))
            parts, sizes = [], [np.zeros(1, np.int64)]
            for _, _, s, at in by_chunk(raw, offsets, width):
                parts.append(s)
                sizes.append(np.diff(at))
            n = np.concatenate(sizes[1:])
            common = common_sizes(np.concatenate(parts), np.concatenate([[0], np.cumsum(n)]))
            linked = _apart(comp, side) & (100 * common >= threshold * (n[:, None] + n[None, :] - common))
            root = {int(c): int(c) for c in comp}

            def top(x: int, root: dict[int, int] = root) -> int:
                while root[x] != x:
                    x = root[x]
                return x

            a, b = [], []
            for i, j in np.argwhere(np.triu(linked, 1)):
                x, y = top(int(comp[i])), top(int(comp[j]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    a.append(cid[i])
                    b.append(cid[j])
            if a:
                yield frame({"a": np.minimum(a, b), "b": np.maximum(a, b)}, PAIRS)

    return _by_key(rows, parts, "cid", "comp", "side", "text").mapInArrow(lean(emit), PAIRS)


class Join:
    """The similarity join of one document table; links(a, b) over class ids are what it finds."""

    def __init__(self, docs: DataFrame, width: int, threshold: int):
        share_code(docs.sparkSession)
        self.width, self.threshold = width, threshold
        k1, k2 = hash_key(F.coalesce("text", F.lit("")))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), k1, k2, "text")
        self.sets = checkpoint(shingle_sets(self.docs, width))
        self.parts = max(1, min(self.sets.rdd.getNumPartitions(), -(-self.sets.count() // ROWS)))
        same = self.sets.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct("_doc", "k1", "k2")).alias("rep"), F.min("doc_id").alias("least"), F.min("sig").alias("sig"))
        self.classes = self.keep(same.select(F.monotonically_increasing_id().alias("cid"), "h1", "h2", "least", "rep", "sig"))
        self.sigs = self.classes.select("cid", "sig")
        self.comps: DataFrame | None = None

    def keep(self, rows: DataFrame) -> DataFrame:
        """rows, checkpointed in no more partitions than the documents need, so that what reads them isn't dealt from more."""
        return checkpoint(self.few(rows))

    def few(self, rows: DataFrame) -> DataFrame:
        return rows.coalesce(self.parts)

    def with_text(self, rows: DataFrame) -> DataFrame:
        """rows (with cid) and the text of each class; of the documents' texts, only those that may be wanted are shuffled."""
        asked = self.few(rows.join(self.classes.select("cid", "rep.*"), "cid"))
        return self.few(sieve(self.docs.select("_doc", "k1", "k2", "text"), asked).dropDuplicates(["_doc", "k1", "k2"]).join(asked, ["_doc", "k1", "k2"])).drop("_doc", "k1", "k2")

    def confirm(self, pairs: DataFrame) -> None:
        """Check pairs (a, b) on full sets. Each a comes once before its partners; it has at most TREES x CHOSEN x SMALL."""
        new = self.keep(pairs.distinct())
        if new.isEmpty():
            return
        sides = self.few(new.select("a").distinct()).select("a", F.lit(0).alias("role"), F.col("a").alias("cid")).union(new.select("a", F.lit(1).alias("role"), F.col("b").alias("cid")))
        width, threshold = self.width, self.threshold

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = np.zeros(0, np.uint64)
            for batch in slices(batches, 512):
                a, role, cid = (batch.column(c).to_numpy() for c in ("a", "role", "cid"))
                ok = np.zeros(len(a), bool)
                for i, j, s, at in by_chunk(*utf8(batch.column("text")), width):
                    for r, y in zip(range(i, j), np.split(s, at[1:-1]), strict=True):
                        if role[r] == 0:
                            x = y
                        elif len(x) and len(y) and min(len(x), len(y)) * 100 >= threshold * max(len(x), len(y)):
                            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                            ok[r] = 100 * both >= threshold * (len(x) + len(y) - both)
                yield frame({"a": a[ok], "b": cid[ok]}, PAIRS)

        self.add(self.with_text(sides).select("a", "role", "cid", "text").repartition("a").sortWithinPartitions("a", "role").coalesce(self.parts).mapInArrow(lean(check), PAIRS))

    def settle(self, rows: DataFrame) -> None:
        """Find all links between components in the runs of equal keys; runs with the same members are one."""
        some = self.keep(_involved(rows, self.parts))
        if not some.isEmpty():
            once = some.select(F.col("members").alias("key"), "cid", "comp", "side").distinct()
            self.add(_settle(self.with_text(self.few(once)), self.parts, self.width, self.threshold))

    def add(self, links: DataFrame) -> None:
        links = self.keep(links)
        if not links.isEmpty():
            known = links if self.comps is None else links.union(self.comps.where("id <> comp").select("comp", "id"))
            self.comps = components(known)

    def labelled(self, nodes: DataFrame) -> DataFrame:
        if self.comps is None:
            return nodes.withColumn("comp", F.col("cid"))
        return self.few(nodes.join(self.comps.withColumnRenamed("id", "cid"), "cid", "left")).withColumn("comp", F.coalesce("comp", "cid"))

    def run(self) -> None:
        frontier = _branch(self.sigs, roots=True)
        for depth in range(1, DEPTH + 1):
            sizes = frontier.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("members")).where("n > 1")
            once = self.few(sizes).groupBy("n", "members").agg(F.min("key").alias("key"))  # nodes with the same classes count once
            nodes = self.keep(frontier.join(self.few(once).select("key", "n"), "key"))
            # nodes share members, so four ways to divide large ones connect most of what one way leaves apart
            blocks = nodes.withColumn("parts", F.call_function("div", F.col("n") + (SMALL - 1), F.lit(SMALL)))
            part = F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.pmod(F.xxhash64("cid", F.pmod("key", F.lit(4))), F.col("parts"))))
            if depth == 1:  # what deeper nodes could connect, these do
                self.confirm(_propose(blocks.select(part.alias("key"), "cid").join(self.sigs, "cid"), self.parts))
            named = self.labelled(nodes)
            shares = self.few(named.groupBy("key", "n", "comp").agg(F.count(F.lit(1)).alias("m"))).groupBy("key", "n").agg(F.max(F.struct("m", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"))
            split = self.few(shares.where("comps > 1")).select("key", "top")
            named = self.keep(named.join(split, "key"))
            small = named.where(F.col("n") <= SMALL).join(self.sigs, "cid").select("key", "cid", "comp", F.lit(0).alias("side"), "sig")
            large = named.where(F.col("n") > SMALL)
            dense = (F.col("top.m") >= DENSE * F.col("n")) | F.lit(depth == DEPTH)
            self.settle(small.union(self._blocks(large.where(dense))))
            left = large.where(~dense)
            if left.isEmpty():
                return
            frontier = checkpoint(_branch(left.select("key", "cid").join(self.sigs, "cid"), roots=False))

    def _blocks(self, large: DataFrame) -> DataFrame:
        """Exhaustive comparison of large nodes: blocks of the classes outside the top component against blocks of all."""
        blocks = lambda n: F.call_function("div", n + (SMALL - 1), F.lit(SMALL))
        sized = large.withColumns({"rest": F.col("comp") != F.col("top.comp"), "p": blocks(F.col("n")), "q": blocks(F.col("n") - F.col("top.m"))})
        everyone = sized.select("key", "cid", "comp", F.lit(1).alias("side"), F.pmod(F.xxhash64("cid", F.lit(1)), "p").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)).alias("j"))
        rest = sized.where("rest").select("key", "cid", "comp", F.lit(0).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)).alias("i"), F.pmod(F.xxhash64("cid", F.lit(2)), "q").alias("j"))
        pairs = everyone.union(rest).select(F.xxhash64("key", "i", "j").alias("key"), "cid", "comp", "side")
        return pairs.join(self.sigs, "cid").select("key", "cid", "comp", "side", "sig")


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept) for every row of docs.

    Two documents are linked when 100 x the size of their common shingles is at least threshold x that of their union.
    component_id is the smallest doc_id that links reach; kept says that it is the row's own. Null or empty texts are linked
    with nothing. Rows with equal doc_id and text share a result; a null doc_id has the component of its class, and is kept
    only if that has no id at all.
    """
    join = Join(docs, width, threshold)
    join.run()
    of_class = join.labelled(join.classes.select("cid", "h1", "h2", "least"))
    reach = of_class.groupBy("comp").agg(F.min("least").alias("component"))
    of_class = of_class.join(reach, "comp").select("h1", "h2", "component")
    rows = join.sets.select("doc_id", "k1", "k2", "n_shingles", "h1", "h2")
    empty = rows.where("n_shingles = 0").withColumn("component", F.col("doc_id"))
    full = rows.where("n_shingles > 0").join(of_class, ["h1", "h2"])
    out = full.select("doc_id", "k1", "k2", "n_shingles", "component").union(empty.select("doc_id", "k1", "k2", "n_shingles", "component"))
    return out.select("doc_id", "k1", "k2", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def unique_documents(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """docs without all but one document of each group of near-duplicates: the one with the smallest doc_id.

    Of rows with equal doc_id and text one stays. Documents without words stay.
    """
    docs, back = set_aside(docs, "doc_id", "text")
    k1, k2 = hash_key(F.coalesce("text", F.lit("")))
    keys = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), k1.alias("_k1"), k2.alias("_k2"))
    marks = near_duplicates(docs, width, threshold)
    stay = marks.where("kept").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    kept = keys.join(stay, ["_doc", "_k1", "_k2"], "left_semi")
    return kept.dropDuplicates(["_doc", "_k1", "_k2"]).select(*back)
