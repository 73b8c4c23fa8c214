"""What the operators share: reliable checkpoints, gapless numbering without a sort, byte views of Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.session import checkpoint, checkpoint_folder, share_code


def spread(df: DataFrame, parts: int) -> DataFrame:
    """df in so many partitions; rows are moved only where that is more than it has."""
    return df.coalesce(parts) if parts < df.rdd.getNumPartitions() else df.repartition(parts)


def checkpoint_folder(spark: SparkSession) -> str:
    sc = share_code(spark).sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skirmish-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def numbered(df: DataFrame, key: str, rank: str = "rank", weight: str | None = None, before: str = "before") -> DataFrame:
    """df with `rank`, gapless from 0 among the rows of each `key`, and with `weight` the running sum `before` each row.

    `key` is a non-null string or integer column. Rows are numbered in the order of a checkpoint of df, so neither a sort
    nor a window over the rows of a hot key is needed: each partition numbers its own rows, and only the counts of
    (partition, key) go through a window. Pass narrow rows: they are written to the checkpoint folder.
    """
    base = checkpoint(df)
    added = [T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())]
    if weight:
        added.append(T.StructField("_before", T.LongType()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, total = TaskContext.get().partitionId(), {}, {}
        for batch in batches:
            k = batch.column(key).to_pandas()
            local = k.groupby(k, sort=False).cumcount().to_numpy() + k.map(seen).fillna(0).to_numpy().astype(np.int64)
            out = [pa.array(np.full(len(k), part, np.int32)), pa.array(local)]
            if weight:
                w = batch.column(weight).to_pandas()
                run = w.groupby(k, sort=False).cumsum().to_numpy() - w.to_numpy() + k.map(total).fillna(0).to_numpy().astype(np.int64)
                out.append(pa.array(run.astype(np.int64)))
                for x, v in w.groupby(k, sort=False).sum().items():
                    total[x] = total.get(x, 0) + int(v)
            for x, n in k.value_counts(sort=False).items():
                seen[x] = seen.get(x, 0) + int(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=[*batch.schema.names, *(f.name for f in added)])

    local = base.mapInArrow(lean(number), T.StructType([*base.schema.fields, *added]))
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(weight).alias("_w")] if weight else [])
    counts = base.groupBy(F.spark_partition_id().alias("_part"), F.col(key)).agg(*sums)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = [F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")]
    if weight:
        start.append(F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_wstart"))
    joined = local.join(counts.select("_part", key, *start), ["_part", key])
    out = [F.col(c) for c in df.columns] + [(F.col("_rank") + F.col("_start")).alias(rank)]
    if weight:
        out.append((F.col("_before") + F.col("_wstart")).alias(before))
    return joined.select(*out)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null row has no bytes."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(a.type) and not pa.types.is_large_binary(a.type):
        a = a.cast(pa.large_binary() if pa.types.is_binary(a.type) else pa.large_string())
    if len(a) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_large_binary(a.type) else "")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes together; a longer row is a run of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def hash_key(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit hashes, which together stand for equal values at any corpus size."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7919), *cols, F.lit("+")).alias("k2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def frame(cols: dict[str, np.ndarray | pa.Array], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    s = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in s], schema=s)


def lean(read: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The reader, which hands memory that it no longer needs back when its task ends: Python workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from read(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `most` rows, so that copies of their columns stay small."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """docs with its columns that an operator doesn't use under names that clash with nothing, and the columns to select in
    the end to have the names of docs again."""
    names = {c: c if c in used else f"extra {i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


SIEVE_BITS = 1 << 23


def sifted(rows: DataFrame, wanted: DataFrame, key: str = "k1") -> DataFrame:
    """rows with a boolean column _may: false only where no row of wanted has the row's key.

    wanted becomes a bitmap of SIEVE_BITS bits, so what is broadcast has one megabyte whatever the input; a bit that several
    keys share lets more rows through and loses none.
    """
    bit = f"pmod({key}, {SIEVE_BITS}) + 1"
    bits = wanted.groupBy(F.expr(f"bitmap_bucket_number({bit})").alias("_bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({bit}))").alias("_bits")).coalesce(1)  # 256 rows at most
    at = f"bitmap_bit_position({bit})"
    byte = f"cast(conv(hex(substring(_bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = rows.withColumn("_bucket", F.expr(f"bitmap_bucket_number({bit})")).join(F.broadcast(bits), "_bucket", "left")
    return marked.withColumn("_may", F.expr(f"coalesce((shiftright({byte}, cast({at} % 8 as int)) & 1) = 1, false)")).drop("_bucket", "_bits")


def sieve(rows: DataFrame, wanted: DataFrame, key: str = "k1") -> DataFrame:
    """rows that may have a key of wanted, so that wide rows need not be shuffled only to be lost in a join on the key."""
    return sifted(rows, wanted, key).where("_may").drop("_may")


class Stored:
    """Parquet tables beside the checkpoints, for what a checkpoint would keep uncompressed; they go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Stored:
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(f"{checkpoint_folder(self.spark)}/{uuid.uuid4().hex}.parquet")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            discard(self.spark, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table, wherever it is stored."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
