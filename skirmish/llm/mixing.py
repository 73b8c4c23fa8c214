"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks of equal bytes. Block k of a source with weight w (weights sum to 1) may be placed from its
release floor(k / w) on and is due by its deadline ceil((k + 1) / w); one block is placed per slot, the released block with
the earliest deadline first. At every slot a source's number of placed blocks then differs from weight x slots by less than
one block. Weights are whole shares of a cycle, so the schedule repeats from cycle to cycle: the driver schedules one cycle
per phase, and a block's slot follows from its number alone. A phase ends when a source has no blocks left; the weights of
the others are then scaled up. Nothing is dropped or repeated.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import frame, hash_key, lean, numbered, set_aside

BLOCK_BYTES = 1 << 18
PART_BYTES = 1 << 25  # of a partition of mixed documents
NONE = ""  # the source of documents without one


def cycle(shares: dict[str, int]) -> dict[str, np.ndarray]:
    """The slots, in one cycle of sum(shares) slots, of each source's blocks: earliest deadline first among the released."""
    total = sum(shares.values())
    names = sorted(shares)
    waiting = [(0, i, 0) for i in range(len(names)) if shares[names[i]]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    slots: dict[str, list[int]] = {n: [] for n in names}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // shares[names[i]]), i, k))
        _, i, k = heapq.heappop(ready)
        slots[names[i]].append(slot)
        if k + 1 < shares[names[i]]:
            heapq.heappush(waiting, ((k + 1) * total // shares[names[i]], i, k + 1))
    return {n: np.array(s, dtype=np.int64) for n, s in slots.items()}


@dataclass
class Phase:
    start: int  # slot
    total: int  # slots of a cycle
    first: dict[str, int]  # by source: its first block in this phase
    slots: dict[str, np.ndarray]


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[Phase]:
    left, done, start, out = {k: v for k, v in blocks.items() if v}, dict.fromkeys(blocks, 0), 0, []
    while left:
        now = {k: shares[k] for k in left}
        slots, total = cycle(now), sum(now.values())
        last = {k: (n - 1) // now[k] * total + int(slots[k][(n - 1) % now[k]]) for k, n in left.items()}
        end = min(last.values()) + 1
        out.append(Phase(start, total, dict(done), slots))
        for k in list(left):
            placed = end // total * now[k] + int(np.searchsorted(slots[k], end % total))
            done[k] += placed
            left[k] -= placed
            if not left[k]:
                del left[k]
        start += end
    return out


def slot_of(plan: list[Phase], source: str, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot, release and deadline of a source's blocks, counted over all phases."""
    slot, release, due = (np.zeros(len(block), np.int64) for _ in range(3))
    for p in plan:
        if source in p.slots and len(share := p.slots[source]):
            here = block >= p.first[source]
            k, n = block[here] - p.first[source], len(share)
            slot[here] = p.start + k // n * p.total + share[k % n]
            release[here], due[here] = p.start + k * p.total // n, p.start - (-(k + 1) * p.total // n)
    return slot, release, due


def scheduled(rows: DataFrame, shares: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows (with source and size) plus block, release, deadline, slot and place, the row's place in its block.

    shares: whole numbers by source; sources that it doesn't name, and all when it is None, have a share of 1. A null source
    is a source of its own. The driver holds one row per source and one cycle of sum(shares) slots for each phase.
    """
    shaped = rows.withColumn("_source", F.coalesce("source", F.lit(NONE)))
    ranked = numbered(shaped, "_source", rank="_rank", weight="size", before="_before").withColumn("block", F.call_function("div", F.col("_before"), F.lit(block_bytes)))
    per = ranked.groupBy("_source").agg((F.max("block") + 1).alias("n")).collect()
    blocks = {r["_source"]: r["n"] for r in per}
    plan = phases(blocks, {k: (shares or {}).get(k, 1) for k in blocks})
    kept = rows.schema.fields
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("block", "release", "deadline", "slot", "place"))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy(zero_copy_only=False)
            source = batch.column("_source").to_pandas().to_numpy()
            out = [np.zeros(len(block), np.int64) for _ in range(3)]
            for s in set(source):
                here = source == s
                for x, v in zip(out, slot_of(plan, s, block[here]), strict=True):
                    x[here] = v
            values = {f.name: batch.column(f.name) for f in kept}
            yield frame({**values, "block": block, "release": out[1], "deadline": out[2], "slot": out[0], "place": batch.column("_rank")}, schema)

    return ranked.mapInArrow(lean(place), schema)


def mix_documents(docs: DataFrame, shares: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document's block, release, deadline, slot and place; size is the text's bytes plus 1, null as empty."""
    rows = docs.select("doc_id", "source", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    return scheduled(rows, shares, block_bytes)


def mixed(docs: DataFrame, shares: dict[str, int] | None = None, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs itself, in the order of the mixture: partition after partition, each sorted by slot and place.

    Rows that are equal in all columns share a place. Only (source, size, hash) rows are numbered; texts are moved twice.
    """
    docs, back = set_aside(docs, "text", "source")
    keyed = docs.select("*", *(c.alias(f"_{n}") for c, n in zip(hash_key(*(f"`{c}`" for c in docs.columns)), ("k1", "k2"), strict=True)))
    rows = keyed.select("_k1", "_k2", "source", (F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1).alias("size"))
    slots = scheduled(rows, shares, block_bytes).groupBy("_k1", "_k2").agg(F.min(F.struct("slot", "place")).alias("_at"))
    last = slots.agg(F.max("_at.slot")).first()[0] or 0
    parts = max(1, -(-(last + 1) * block_bytes // part_bytes))
    part = F.call_function("div", F.col("_at.slot") * parts, F.lit(last + 1)).cast("int")
    return keyed.join(slots, ["_k1", "_k2"]).repartitionById(parts, part).sortWithinPartitions("_at.slot", "_at.place").select(*back)
