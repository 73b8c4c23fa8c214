"""Removal of long byte strings that occur more than once.

Every string of LEAST bytes has an anchor: among its GRAM-byte grams the one with the least hash, the leftmost of equals.
Equal strings have equal anchors at equal offsets, so only strings with equal anchors need to be compared. The strings that
neighbour each other and have one anchor form a range; a range is divided into sections by the anchor's offset, and what all
strings of a section must contain, with its hash, is the section's key. Sections with a key of their own cannot repeat.

- A first pass counts anchor hashes; a bitmap of those that occur again sifts the sections of the second pass.
- Sections that agree with another of their key in all their bytes need no closer look: all strings in them repeat.
- Of the other keys with several kinds of sections, one of each kind goes, group by group, through a Burrows-Wheeler
  transform whose breadth-first interval expansion tells the common prefixes (`bwt.repeated_starts`).
- A group of more than LARGE kinds is first split by offsets, with new keys, until it is small: keys of one drop out, groups
  that agree in all bytes are settled, and at a single offset all agree.

- Passages of a number of words that have fewer bytes than LEAST are counted by themselves, by 128-bit digests: only short
  words make them, so they are few.

Nothing is collected, sampled or capped; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.bwt import repeated_starts
from skirmish.llm.common import Stored, checkpoint, chunks, frame, hash_key, lean, mix64, set_aside, sieve, sifted, utf8
from skirmish.llm.shingles import prefix_hash, span_hash, word_edges
from skirmish.session import share_code

LEAST, GRAM = 400, 128
SECTIONS = 2  # of the offsets that an anchor can have in a string
LARGE = 512  # kinds of sections of a group that one transform takes
TOGETHER = 64  # kinds, of several groups, at which a transform starts: its tables then stay in the processor's cache
ROWS, COMPARED = 4096, 512  # rows of a partition of the tables of sections, and of those that are compared
SEGMENT = 4 << 20  # bytes of a long text that are read at once

_L, _I = T.LongType(), T.IntegerType()
#: A section: its key, a hash of all it is, its text, the place of the anchor, and in one number of four times 16 bits the
#: offsets lo to hi that it stands for, and the least and greatest offset of the anchor in its own strings.
PARTS = T.StructType([T.StructField(c, _L) for c in ("key", "all", "a", "k1", "k2", "pos", "span")])
LO, HI, FIRST, LAST = 48, 32, 16, 0
#: A kind of section with its bytes; left: bytes before the anchor; id and kind: key and hash of the section it came from.
KINDS = T.StructType([T.StructField("key", _L), T.StructField("all", _L), T.StructField("id", _L), T.StructField("kind", _L), T.StructField("owner", _L), T.StructField("left", _I), T.StructField("lo", _I), T.StructField("hi", _I), T.StructField("bytes", T.BinaryType())])
MARKS = T.StructType([T.StructField("id", _L), T.StructField("kind", _L), T.StructField("from", _I), T.StructField("to", _I)])
SPANS = T.ArrayType(T.StructType([T.StructField("lo", _L), T.StructField("hi", _L)]))
#: A short passage of a text: its digest, how often the text has it, and the bytes that it covers there, in maximal runs.
PASSAGES = T.StructType([*(T.StructField(c, _L) for c in ("d1", "d2", "k1", "k2", "n")), T.StructField("spans", SPANS)])


def _least_of(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(place, hash, first, last) of every anchor: where its gram starts, and the starts of the strings it is the anchor of."""
    starts = np.flatnonzero(np.diff(offsets) >= least)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = prefix_hash(raw)
    g = mix64(span_hash(p, slice(None, -gram), slice(gram, None), slice(None, len(raw) - gram + 1)), 61)
    m = _least_of((g >> np.uint64(28) << np.uint64(28)) | np.arange(len(g), dtype=np.uint64), least - gram + 1)
    may = np.zeros(len(m) + 1, np.int32)  # where a string starts that lies within one row
    np.add.at(may, offsets[starts], 1)
    np.add.at(may, offsets[starts + 1] - least + 1, -1)
    at = np.flatnonzero(np.cumsum(may[:-1]) > 0)
    m = m[at]
    edge = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    place = (m[edge] & np.uint64((1 << 28) - 1)).astype(np.int64)
    return place, g[place], at[edge], at[np.append(edge[1:], len(at)) - 1]


def _read(batch: pa.RecordBatch, least: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, bytes before it, bytes, offsets) of runs of whole rows, and of the segments of a long one.

    A segment shares all but one byte of a string with the next one, so each string lies in one segment.
    """
    raw, offsets = utf8(batch.column("text"))
    for i, j in chunks(offsets):
        if j - i > 1 or offsets[j] - offsets[i] <= SEGMENT:
            yield i, 0, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        else:
            for s in range(0, int(offsets[j] - offsets[i]) - least + 1, SEGMENT):
                part = raw[offsets[i] + s : min(offsets[j], offsets[i] + s + SEGMENT + least - 1)]
                yield i, s, part, np.array([0, len(part)])


def _anchor_hashes(texts: DataFrame, least: int, gram: int) -> DataFrame:
    """The hash of each anchor, once for each of its ranges."""
    schema = T.StructType([T.StructField("a", _L)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in _read(batch, least):
                yield frame({"a": anchors(raw, at, least, gram)[1].view(np.int64)}, schema)

    return texts.select("text").mapInArrow(lean(read), schema)


def _section_rows(texts: DataFrame, least: int, gram: int, sections: int) -> DataFrame:
    edges = [round(x * (least - gram + 1) / sections) for x in range(sections + 1)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for i, before, raw, at in _read(batch, least):
                place, a, start, end = anchors(raw, at, least, gram)
                if not len(place):
                    continue
                p = prefix_hash(raw)
                row = np.searchsorted(at, place, side="right") - 1
                for lo, hi in zip(edges[:-1], [e - 1 for e in edges[1:]], strict=True):
                    first, last = np.maximum(lo, place - end), np.minimum(hi, place - start)
                    ok = first <= last
                    x, f, g = place[ok], first[ok], last[ok]
                    key = mix64(span_hash(p, x - lo, x + least - hi, x - lo) ^ mix64(a[ok], 64), 65 + lo)
                    every = mix64(span_hash(p, x - g, x + least - f, x - g) ^ mix64((f * 65536 + g).astype(np.uint64), 63), 62)
                    rows = {"key": key.view(np.int64), "all": every.view(np.int64), "a": a[ok].view(np.int64), "k1": k1[i + row[ok]], "k2": k2[i + row[ok]], "pos": before + x - at[row[ok]], "span": (lo << LO) + (hi << HI) + (f << FIRST) + (g << LAST)}
                    yield frame(rows, PARTS)

    return texts.select("k1", "k2", "text").mapInArrow(lean(read), PARTS)


def _cut(asked: DataFrame, least: int) -> DataFrame:
    """The bytes of the sections that `want` asks of each text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in KINDS}
            owners = mix64(batch.column("k1").to_numpy().view(np.uint64), 71)
            for text, want, owner in zip(batch.column("text"), batch.column("want").to_pylist(), owners.tolist(), strict=True):
                text = text.as_py().encode()
                for w in want:
                    lo, hi, first, last = ((w["span"] >> k) & 65535 for k in (LO, HI, FIRST, LAST))
                    begin = w["pos"] - last
                    for name, v in zip(out, (w["key"], w["all"], w["key"], w["all"], (owner + begin) % (1 << 64), last, lo, hi, text[begin : w["pos"] + least - first]), strict=True):
                        out[name].append(v)
            out["owner"] = np.array(out["owner"], dtype=np.uint64).view(np.int64)
            out["bytes"] = pa.array(out["bytes"], pa.binary())
            yield frame(out, KINDS)

    return asked.mapInArrow(lean(read), KINDS)


def _halves(nodes: DataFrame, least: int, gram: int) -> DataFrame:
    """Each section in the halves of its offsets, with the keys of those."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in KINDS}
            for r in batch.to_pylist():
                data, left, mid = r["bytes"], r["left"], (r["lo"] + r["hi"]) // 2
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    first, last = max(lo, left + least - len(data)), min(hi, left)
                    if lo > hi or first > last:
                        continue
                    must, whole = data[left - lo : left + least - hi], data[left - last : left + least - first]
                    for name, v in zip(out, (_digest(r["key"], lo, hi, must), _digest(last, first, whole), r["id"], r["kind"], (r["owner"] + left - last) % (1 << 64), last, lo, hi, whole), strict=True):
                        out[name].append(v)
            out["owner"] = np.array(out["owner"], dtype=np.uint64).view(np.int64)
            out["bytes"] = pa.array(out["bytes"], pa.binary())
            yield frame(out, KINDS)

    return nodes.select(*KINDS.names).mapInArrow(lean(split), KINDS)


def _digest(*parts: int | bytes) -> int:
    h = hashlib.blake2b(digest_size=8)
    for x in parts:
        h.update(x if isinstance(x, bytes) else b"%d," % x)
    return int.from_bytes(h.digest(), "little", signed=True)


def _compare(kinds: DataFrame, least: int, rows: int) -> DataFrame:
    """Marks of the strings that repeat among sections with equal keys; a place of the corpus counts once. rows: how many
    kinds there are at most. A transform costs more time than its bytes tell, so the number of tasks is set by rows."""
    parts = max(1, min(int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // COMPARED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def marks() -> pa.RecordBatch:
            out: dict[str, list] = {f.name: [] for f in MARKS}
            starts = repeated_starts([h[4] for h in held], np.array([h[2] for h in held], dtype=np.int64).view(np.uint64), least)
            for (key, kind, _, left, _), x in zip(held, starts, strict=True):
                if len(x):
                    edge = np.flatnonzero(np.diff(x) > 1)
                    for i, j in zip(x[np.append(0, edge + 1)], x[np.append(edge, len(x) - 1)], strict=True):
                        for name, v in zip(out, (key, kind, i - left, j + least - left), strict=True):
                            out[name].append(v)
            return frame(out, MARKS)

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "id", "kind", "owner", "left", "bytes")]
            for key, *rest in zip(*cols, strict=True):
                if key != last and len(held) >= TOGETHER:
                    yield marks()
                    held = []
                held.append(tuple(rest))
                last = key
        if held:
            yield marks()

    return kinds.select("key", "id", "kind", "owner", "left", "bytes").repartition(parts, "key").sortWithinPartitions("key").coalesce(parts).mapInArrow(lean(run), MARKS)


def _of(span: str, shift: int) -> Column:
    return F.shiftright(span, shift).bitwiseAND(65535).cast("int")


def short_passages(raw: np.ndarray, offsets: np.ndarray, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of every run of `words` whole words of one row that has fewer than `least` bytes."""
    starts, ends = word_edges(raw, offsets)
    first, end = starts[: max(0, len(starts) - words + 1)], ends[words - 1 :]
    ok = (end - first < least) & (np.searchsorted(offsets, first, side="right") == np.searchsorted(offsets, end, side="left"))
    return first[ok], end[ok]


def _passage_rows(texts: DataFrame, words: int, least: int) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            whole, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                size = int(offsets[j] - offsets[i])
                for s in range(0, size if j - i == 1 else 1, SEGMENT):  # a segment of a long row, with a byte before and those that its last passages need
                    begin, stop = max(0, s - 1), min(size, s + SEGMENT + least) if j - i == 1 else size
                    raw = whole[offsets[i] + begin : offsets[i] + stop]
                    at = offsets[i : j + 1] - offsets[i] if j - i > 1 else np.array([0, len(raw)])
                    first, end = short_passages(raw, at, words, least)
                    if j - i == 1:
                        ok = (first + begin >= s) & (first + begin < s + SEGMENT)
                        first, end = first[ok], end[ok]
                    if not len(first):
                        continue
                    data = raw.tobytes()
                    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), end.tolist(), strict=True))
                    d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    row = np.searchsorted(at, first, side="right") - 1
                    order = np.lexsort((first, d[:, 1], d[:, 0], row))
                    d, row, lo, hi = d[order], row[order], begin + (first - at[row])[order], begin + (end - at[row])[order]
                    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (d[1:] != d[:-1]).any(axis=1)])  # of one text and digest, one row
                    runs = np.flatnonzero(fresh | np.concatenate([[True], lo[1:] > hi[:-1]]))
                    one = np.flatnonzero(fresh)
                    spans = pa.StructArray.from_arrays([pa.array(lo[runs]), pa.array(hi[np.append(runs[1:], len(hi)) - 1])], names=["lo", "hi"])
                    bounds = np.append(np.searchsorted(runs, one), len(runs)).astype(np.int32)
                    yield frame({"d1": d[one, 0], "d2": d[one, 1], "k1": k1[i + row[one]], "k2": k2[i + row[one]], "n": np.diff(np.append(one, len(row))), "spans": pa.ListArray.from_arrays(bounds, spans)}, PASSAGES)

    return texts.select("k1", "k2", "text").mapInArrow(lean(read), PASSAGES)


def _passage_places(docs: DataFrame, words: int, least: int) -> DataFrame:
    """(k1, k2, lo, hi): the bytes that repeated passages of `words` words with fewer than `least` bytes cover.

    A passage has a byte a word and one between words at least, so those that start in one block of so many bytes overlap.
    """
    block = 2 * words - 1
    passages = _passage_rows(docs.where(F.octet_length("text") >= block), words, least)
    again = checkpoint(passages.groupBy("d1", "d2").agg(F.sum("n").alias("n")).where("n > 1").select("d1", "d2"))
    found = sieve(passages, again, "d1").join(again, ["d1", "d2"]).select("k1", "k2", F.explode("spans").alias("at")).select("k1", "k2", "at.*")
    return checkpoint(found.groupBy("k1", "k2", F.call_function("div", "lo", F.lit(block)).alias("_block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_block"))


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, sections: int = SECTIONS, words: int | None = None) -> DataFrame:
    """(k1, k2, spans) for each text with bytes to remove; k1, k2: its hashes (null as empty), spans: (lo, hi) in bytes."""
    with Stored(docs.sparkSession) as stored:
        return checkpoint(_repeated_spans(docs, least, gram, sections, words, stored))


def _repeated_spans(docs: DataFrame, least: int, gram: int, sections: int, words: int | None, stored: Stored) -> DataFrame:
    share_code(docs.sparkSession)
    parts_of = lambda n: max(1, -(-n // ROWS))
    k1, k2 = hash_key(F.coalesce("text", F.lit("")))
    every_text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_doc"), k1, k2, "text")
    keyed = every_text.where(F.octet_length("text") >= least)
    again = checkpoint(_anchor_hashes(keyed, least, gram).groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a"))
    parts = stored(sieve(_section_rows(keyed, least, gram, sections), again, "a").drop("a"))
    kinds = parts.groupBy("key", "all").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "pos", "span")).alias("at"))
    groups = kinds.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.sum((F.col("n") == 1).cast("long")).alias("once")).where("n > 1")
    kinds = checkpoint(kinds.withColumnRenamed("n", "same").join(groups, "key").coalesce(parts_of(parts.count())))
    marks = [kinds.where("same > 1").select(F.col("key").alias("id"), F.col("all").alias("kind"), (-_of("at.span", LAST)).alias("from"), (F.lit(least) - _of("at.span", FIRST)).alias("to"))]
    # keys whose sections are of several kinds, unless all of them are already known to repeat
    asked = kinds.where("m > 1 AND once > 0").select("key", "all", "at.*")
    n = asked.count()
    few = parts_of(n)
    asked = asked.coalesce(few)
    one = keyed.select("k1", "k2", "_doc").groupBy("k1", "k2").agg(F.min("_doc").alias("_doc"))
    want = asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "all", "pos", "span")).alias("want"))
    want = checkpoint(want.coalesce(few).join(one, ["k1", "k2"]).coalesce(few))
    texts = sieve(keyed, want).join(want, ["k1", "k2", "_doc"]).select("k1", "text", "want")
    cut = checkpoint(_cut(texts.coalesce(few), least).dropDuplicates(["key", "all"]).coalesce(few))
    sized = checkpoint(cut.join(kinds.select("key", "m").distinct(), "key").coalesce(few))
    marks.append(_compare(sized.where(F.col("m") <= LARGE), least, n))
    nodes = sized.where(F.col("m") > LARGE)
    while not nodes.isEmpty():
        nodes = checkpoint(_halves(nodes, least, gram))
        n = nodes.count()
        few = parts_of(n)
        sorts = nodes.groupBy("key", "all").agg(F.count(F.lit(1)).alias("same")).coalesce(few).groupBy("key").agg(F.sum("same").alias("n"), F.count(F.lit(1)).alias("kinds")).where("n > 1")
        sized = checkpoint(nodes.coalesce(few).join(sorts, "key").coalesce(few))
        marks.append(sized.where("kinds = 1").select("id", "kind", (-F.col("left")).alias("from"), (F.octet_length("bytes") - F.col("left")).alias("to")))
        marks.append(_compare(sized.where((F.col("kinds") > 1) & (F.col("n") <= LARGE)), least, n))
        nodes = sized.where((F.col("kinds") > 1) & (F.col("n") > LARGE))
    every = marks[0]
    for m in marks[1:]:
        every = every.union(m)
    places = parts.join(every, (parts["key"] == every["id"]) & (parts["all"] == every["kind"])).select("k1", "k2", (F.col("pos") + F.col("from")).alias("lo"), (F.col("pos") + F.col("to")).alias("hi"))
    if words:
        places = places.union(_passage_places(every_text, words, least))
    return places.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """docs with its text cut, and added columns _bytes, _removed, _spans (runs) and _sha256 of the remaining bytes.

    Each byte goes that is covered by a string of `least` bytes that also starts anywhere else in the texts, the same text
    included; strings are judged on the input. With `words`, strings of so many whole words count as well, however few bytes
    they have; white space is as in shingles, and parts words. A null or empty text has no bytes and stays as it is. Where a cut goes
    through a character, the text loses what is left of the character, while the checksum is that of the remaining bytes.
    Repeated rows are documents of their own, so their texts repeat. Columns of docs with these names are replaced.
    """
    added = [T.StructField("_bytes", _L), T.StructField("_removed", _L), T.StructField("_spans", SPANS), T.StructField("_sha256", T.StringType())]
    docs, back = set_aside(docs.drop(*(f.name for f in added)), "doc_id", "text")
    names = docs.columns
    spans = repeated_spans(docs, least, gram, words=words).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "spans")
    k1, k2 = hash_key(F.coalesce("text", F.lit("")))
    marked = sifted(docs.select(*names, k1.alias("_k1"), k2.alias("_k2")), spans, "_k1")
    whole = marked.where("NOT _may").select(*names, F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))  # not shuffled
    joined = marked.where("_may").join(spans, ["_k1", "_k2"], "left").select(*names, "spans").union(whole)
    schema = T.StructType([*(T.StructField("text", T.StringType()) if c == "text" else docs.schema[c] for c in names), *added])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = [], {f.name: [] for f in added}
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                text = text.as_py()
                data, runs = (text or "").encode(), merged(found.as_py())
                left = without(data, runs) if runs else data
                texts.append(left.decode("utf-8", "ignore") if runs else text)
                for name, v in zip(out, (len(data), len(data) - len(left), [{"lo": a, "hi": b} for a, b in runs], hashlib.sha256(left).hexdigest()), strict=True):
                    out[name].append(v)
            values = {c: batch.column(c) for c in names} | {"text": texts} | out
            yield frame(values, schema)

    return joined.mapInArrow(lean(cut), schema).select(*back, *(f.name for f in added))
