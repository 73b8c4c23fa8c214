"""Best-fit packing with certified bin counts.

Documents become token sequences; sequences longer than the capacity are cut into capacity-long pieces with the shorter
piece first. Items of one length are interchangeable, so packing works on counts by length: every packing partition has a
histogram of at most `capacity` numbers, whatever the corpus size, and best-fit decreasing places whole runs of equal items
at once. A dual-feasible-function lower bound certifies a partition whose bin count it meets. Partitions with a gap put
the documents of bins with room into a common pool and rerun best-fit decreasing there, if that saves bins: first those of
the emptiest bins, then, as long as the bound over all items is not met, those of all bins that aren't full. Where the total is still above the bound over all items, certified partitions do so too. The plan (runs of equal items, to runs of bins) goes back to the executors, where each piece finds its
place from its rank among the pieces of its length: the pieces themselves are neither sorted nor moved to one place.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import frame, lean, numbered

CAPACITY = 1024
END = 2
PARTITIONS = 8
ROOMS = (512, 256, 128, 64, 32, 16, 8, 4, 2, 1)  # the least room of bins whose items are exchanged, tried in turn
CLASSES = 4096  # class of a piece: CLASSES x its packing partition + its length
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("class", T.LongType()),
])
#: Characters on which both tokenizer libraries are known to split alike; other texts go to the reference library itself.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſ‐-‧]*")


class Ids:
    """Token ids of texts as the tokenizer file gives them, without added tokens.

    The rank file with the same vocabulary gives equal ids several times faster; texts with special-token marks or unusual
    characters use the tokenizer file itself, so that the ids are the same in every case.
    """

    def __init__(self, vocabulary: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(vocabulary)
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and "<|" not in text and PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", window: Column | None = None) -> DataFrame:
    """One row per piece of each document: its place in the document, its length and the checksum of its ids.

    window: the packing partition of a document, from 0 on; without it, documents are dealt over PARTITIONS of them. A null text counts as empty, and an empty text has the end id alone. Repeated rows are documents of their own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(vocabulary, ranks)
        for batch in batches:
            ids, texts, windows = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            out: dict[str, list] = {f.name: [] for f in PIECES}
            for i, doc in enumerate(ids):
                tokens = np.array([*ids_of(texts[i].as_py() or ""), end], dtype="<u4")
                n = len(tokens)
                first = n if n <= capacity else n % capacity or capacity
                for j, at in enumerate([0, *range(first, n, capacity)]):
                    piece = tokens[at : first if j == 0 else at + capacity]
                    for k, v in zip(out, (doc, j, at, len(piece), zlib.crc32(piece.tobytes()), windows[i] * CLASSES + len(piece)), strict=True):
                        out[k].append(v)
            yield frame(out, PIECES)

    window = F.spark_partition_id() % PARTITIONS if window is None else window
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), window.cast("long").alias("window")).mapInArrow(lean(cut), PIECES)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """The best of several dual-feasible-function bounds on the bins that the items need.

    Rounding: items over capacity - t count as whole bins and items under t as nothing, for each t up to half the capacity.
    Stepping: with k, an item x counts (k + 1) x / capacity rounded down, in k-ths, and unrounded where that is whole.
    """
    lengths = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    if not len(lengths):
        return 0
    best = -(-int((lengths * counts).sum()) // capacity)
    for t in {int(x) for x in lengths if x <= capacity // 2} | {int(capacity - x) for x in lengths if 2 * x > capacity}:
        seen = np.where(lengths > capacity - t, capacity, np.where(lengths < t, 0, lengths))
        best = max(best, -(-int((seen * counts).sum()) // capacity))
    for k in range(1, 33):
        top = (k + 1) * lengths
        seen = np.where(top % capacity == 0, lengths * k, (top // capacity) * capacity)
        best = max(best, -(-int((seen * counts).sum()) // (k * capacity)))
    return best


@dataclass
class Run:
    """Items [lo, hi) of a length: `each` of them in a row in every bin from `bin`, from `offset` on; the first has `phase` before it."""

    length: int
    lo: int
    hi: int
    each: int
    bin: int
    offset: int
    phase: int = 0

    def part(self, lo: int, hi: int) -> Run:
        return Run(self.length, lo, hi, self.each, self.bin, self.offset, self.phase + lo - self.lo)


@dataclass
class Packed:
    bins: int
    runs: list[Run]
    free: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by room left: runs (first bin, number of bins)


def best_fit(histogram: dict[int, int], capacity: int) -> Packed:
    """Best-fit decreasing over counts by length, placing runs of equal items in runs of bins with equal room."""
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []  # rooms with bins, ascending
    runs: list[Run] = []
    bins = 0

    def put(room: int, first: int, n: int) -> None:
        if n <= 0:
            return
        if not rooms[room]:
            bisect.insort(order, room)
        rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        done, n = 0, histogram[length]
        while done < n:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, m = rooms[room].pop()
                if not rooms[room]:
                    order.pop(at)
            else:
                room, first = capacity, bins
                m = -(-(n - done) // (capacity // length))
                bins += m
            each = room // length
            full = min(m, (n - done) // each)
            offset = capacity - room
            if full:
                runs.append(Run(length, done, done + full * each, each, first, offset))
                done += full * each
                put(room - each * length, first, full)
            rest = n - done
            if full < m and rest:
                rest = min(rest, each)
                runs.append(Run(length, done, done + rest, rest, first + full, offset))
                done += rest
                put(room - rest * length, first + full, 1)
                full += 1
            put(room, first + full, m - full)
    return Packed(bins, runs, {k: v for k, v in rooms.items() if v})


def exchange(packed: dict[int, Packed], some: list[int], capacity: int, room: int = 1) -> tuple[dict[int, Packed], list[tuple[int, Run]], int]:
    """Some partitions without their bins that have room, and the runs of those bins' items, packed together in so many bins."""
    out: list[tuple[int, Run]] = []
    pool: dict[int, list[tuple[int, Run]]] = defaultdict(list)
    kept: dict[int, Packed] = {}
    for g in some:
        open_bins = np.zeros(packed[g].bins, bool)
        for first, n in (x for left, runs in packed[g].free.items() if left >= room for x in runs):
            open_bins[first : first + n] = True
        number = np.cumsum(~open_bins) - 1
        kept[g] = Packed(int((~open_bins).sum()), [])
        for run in packed[g].runs:
            bins = -(-(run.hi - run.lo) // run.each)
            edge = np.flatnonzero(np.diff(open_bins[run.bin : run.bin + bins].astype(np.int8))) + 1
            for a, b in zip([0, *edge], [*edge, bins], strict=True):
                part = run.part(run.lo + int(a) * run.each, min(run.hi, run.lo + int(b) * run.each))
                if open_bins[run.bin + a]:
                    pool[run.length].append((g, part))
                else:
                    kept[g].runs.append(Run(run.length, part.lo, part.hi, run.each, int(number[run.bin + a]), run.offset))
    exchanged = best_fit({k: sum(r.hi - r.lo for _, r in v) for k, v in pool.items()}, capacity)
    by_length: dict[int, list[Run]] = defaultdict(list)
    for run in exchanged.runs:
        by_length[run.length].append(run)
    for length, parts in pool.items():
        runs, at, i = by_length[length], 0, 0
        for g, part in parts:
            end = at + part.hi - part.lo
            while i < len(runs) and runs[i].lo < end:
                lo, hi = max(runs[i].lo, at), min(runs[i].hi, end)
                cut = runs[i].part(lo, hi)
                out.append((g, Run(length, part.lo + lo - at, part.lo + hi - at, cut.each, cut.bin, cut.offset, cut.phase)))
                if runs[i].hi > end:
                    break
                i += 1
            at = end
    return kept, out, exchanged.bins


def pack(histograms: dict[int, dict[int, int]], capacity: int = CAPACITY) -> tuple[list[tuple[int, Run]], dict]:
    """Runs by packing partition, with bins numbered partition after partition and then those of exchanged items, and a
    report of the certificates."""
    packed = {g: best_fit(h, capacity) for g, h in sorted(histograms.items())}
    bound = {g: lower_bound(h, capacity) for g, h in histograms.items()}
    whole: dict[int, int] = defaultdict(int)
    for h in histograms.values():
        for k, v in h.items():
            whole[k] += v
    least = lower_bound(whole, capacity)
    total = sum(p.bins for p in packed.values())
    kept, pooled, pooled_bins, joined = {}, [], 0, []
    # partitions with a gap first, then, as long as the bound over all items is not met, all
    for some in ([g for g in packed if packed[g].bins > bound[g]], list(packed)):
        for room in ROOMS:  # as few bins as serve: what is exchanged leaves its partition
            if len(some) > 1 and total > least:
                full, runs, bins = exchange(packed, some, capacity, room)
                now = bins + sum(full.get(g, p).bins for g, p in packed.items())
                if now < total:
                    kept, pooled, pooled_bins, joined, total = full, runs, bins, some, now
    out: list[tuple[int, Run]] = []
    at = 0
    for g, p in [*((g, kept.get(g, p)) for g, p in packed.items()), (-1, Packed(pooled_bins, []))]:
        for h, run in pooled if g < 0 else ((g, r) for r in p.runs):
            run.bin += at
            out.append((h, run))
        at += p.bins
    report = {"bins": total, "bound": least, "partitions": {g: (packed[g].bins, bound[g]) for g in packed}, "exchanged": joined}
    return out, report


def place(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (with columns length, 1 to capacity, and class) with sequence_id and offset.

    The sequences of a packing partition come before those of the next; those of exchanged pieces, few for each partition,
    come last. The driver gets at most capacity counts for each packing partition. The plan is as small: it depends on the number of lengths only.

    Pieces are narrow and streamed, so as many partitions as there are cores hold them, whatever the numbers of input and
    shuffle partitions: each file on a local disk makes the executor's JVM start processes, and a process that is just being
    started counts with all of the JVM's memory.
    """
    kept = [f for f in items.schema.fields if f.name != "class"]
    parts = max(PARTITIONS, items.sparkSession.sparkContext.defaultParallelism)
    ranked = numbered(items.repartition(parts), "class", rank="rank").coalesce(parts)
    rows = ranked.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()
    histograms: dict[int, dict[int, int]] = defaultdict(dict)
    for r in rows:
        histograms[r["class"] // CLASSES][r["class"] % CLASSES] = r["n"]
    plan, _ = pack(histograms, capacity)
    plan.sort(key=lambda x: (x[0] * CLASSES + x[1].length, x[1].lo))
    wide = 1 << 40
    start = np.array([(g * CLASSES + r.length) * wide + r.lo for g, r in plan], dtype=np.int64)
    cols = [np.array([getattr(r, k) for _, r in plan], dtype=np.int64) for k in ("lo", "each", "bin", "offset", "phase")]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, each, first, offset, phase = cols
        for batch in batches:
            rank, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rank", "length"))
            at = np.searchsorted(start, batch.column("class").to_numpy(zero_copy_only=False) * wide + rank, side="right") - 1
            inside = rank - lo[at] + phase[at]
            values = {k.name: batch.column(k.name) for k in kept}
            yield frame({**values, "sequence_id": first[at] + inside // each[at], "offset": offset[at] + inside % each[at] * length}, schema)

    return ranked.mapInArrow(lean(look_up), schema)


def pack_documents(docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY, window: Column | None = None) -> DataFrame:
    """Every document's pieces with their places in as few sequences of at most `capacity` tokens as the method finds.

    With window, a whole number from 0 on for each document, sequences follow its order, but for those of exchanged pieces.
    """
    return place(pieces(docs, vocabulary, ranks, capacity, window=window), capacity)


