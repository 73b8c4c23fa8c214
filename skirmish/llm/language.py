"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's features are the hashes of its byte n-grams (1 to 4 bytes, lower-cased, everything but letters as one space mark).
Each hash has an embedding; their average goes through a linear softmax. Embeddings and softmax are trained together by
stochastic gradient descent in numpy, on random passages of a bounded sample of labelled documents. A part of the sample is
left out of the descent and calibrates the result: a temperature for the probabilities, the probability under which a
prediction is rejected, and the share of known n-grams under which a text is foreign to all languages.

Prediction reads whole texts. As softmax follows a linear map of an average, the map is applied to the embeddings first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import chunks, frame, lean, slices, utf8
from skirmish.session import share_code

UNKNOWN = "und"
BUCKETS = 1 << 15
GRAMS = (1, 2, 3, 4)
#: The most labelled documents of a language in the training sample.
SAMPLE_PER_LANGUAGE = 2_000
#: The most characters of a training text that the driver gets: descent takes passages of at most 400 bytes from them.
SAMPLE_CHARS = 1 << 14
#: The share of correct calibration documents that rejection may cost; the probability that is never rejected, and the
#: multiple of chance beyond which none is: texts in two languages at once are unsure, but not foreign.
REJECTED_SHARE, NEVER_REJECTED, CHANCE = 0.001, 0.5, 1.45
#: Texts with fewer known n-grams than this part of what calibration texts have are rejected as foreign.
FAMILIAR = 0.9
#: Descent steps that a small sample gets by more epochs.
LEAST_STEPS = 200
OUT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = _ASCII_LETTER[65:91] = True


def buckets(raw: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each n, the bucket of the n-gram at each byte; BUCKETS where it would leave its row or is all spaces."""
    folded = _FOLD[raw].astype(np.uint32)
    code, out = np.zeros(len(raw), np.uint32), []
    space = folded == 32
    blank = np.ones(len(raw), bool)
    for n in GRAMS:
        shift = n - 1
        size = max(0, len(raw) - shift)
        code[:size] = code[:size] * np.uint32(256) + folded[shift:] if n > 1 else folded
        blank[:size] &= space[shift:]
        h = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA77)
        b = (h >> np.uint32(32 - 15)).astype(np.int32)
        b[blank] = BUCKETS
        for k in range(1, n):
            b[ends[ends >= k] - k] = BUCKETS
        out.append(b)
    return out


def has_letter(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    ascii_letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[raw])])
    found = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~found):
        part = raw[offsets[i] : offsets[i + 1]]
        if len(part) and part.max() > 127:
            found[i] = any(c.isalpha() for c in part.tobytes().decode("utf-8", "ignore"))
    return found


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages + 1) float32: logits of each bucket, and 1 for one that training met
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = 0.0

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The languages' logits, and the share of n-grams that training met, of each row."""
        total, n = np.zeros((len(offsets) - 1, self.table.shape[1])), np.zeros(len(offsets) - 1)
        starts, ends = offsets[:-1], offsets[1:]
        some = ends > starts
        if some.any():
            for b in buckets(raw, ends[some]):
                total[some] += np.add.reduceat(self.table[b], starts[some], axis=0)
                n[some] += np.add.reduceat((b < BUCKETS).astype(np.int32), starts[some])
        n = np.maximum(n, 1)
        return total[:, :-1] / n[:, None] + self.bias, total[:, -1] / n

    def rejects(self, score: np.ndarray, met: np.ndarray) -> np.ndarray:
        return (score < self.threshold) | (met < self.familiar)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7, dims: int = 16, passages: int = 4, epochs: int = 4, rate: float = 0.5) -> Model:
    """A model of the languages in labels. Nothing to learn from gives a model without languages, which rejects all."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS + 1, 1), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y_of = {x: i for i, x in enumerate(languages)}
    held = rng.random(len(texts)) < 0.15
    spans, y = [], []
    for i in np.flatnonzero(~held):
        b = texts[i].encode()
        for _ in range(passages):
            n = int(min(len(b), rng.integers(12, 400)))
            at = int(rng.integers(0, len(b) - n + 1))
            spans.append(b[at : at + n])
            y.append(y_of[labels[i]])
    y = np.array(y, dtype=np.int64)
    epochs = max(epochs, -(-LEAST_STEPS // max(1, -(-len(spans) // 128))))
    emb = np.zeros((BUCKETS + 1, dims))
    known = np.zeros(BUCKETS + 1, np.float32)
    weights, bias = rng.normal(0, 1, (dims, len(languages))), np.zeros(len(languages))
    steps, done = max(1, epochs * -(-len(spans) // 128)), 0
    for _ in range(epochs):
        order = rng.permutation(len(spans))
        for lo in range(0, len(order), 128):
            pick = order[lo : lo + 128]
            part = [spans[i] for i in pick if len(spans[i])]
            if not part:
                continue
            target = y[[i for i in pick if len(spans[i])]]
            raw = np.frombuffer(b"".join(part), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(x) for x in part])])
            row = np.repeat(np.arange(len(part)), np.diff(at))
            grams = buckets(raw, at[1:])
            feature, owner = np.concatenate(grams), np.concatenate([row] * len(GRAMS))
            inside = feature < BUCKETS
            feature, owner = feature[inside], owner[inside]
            known[feature] = 1
            size = np.maximum(np.bincount(owner, minlength=len(part)), 1)[:, None]
            sums = np.stack([np.bincount(owner, emb[feature, d], len(part)) for d in range(dims)], axis=1)
            hidden = sums / size
            z = hidden @ weights + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), target] -= 1
            step = rate * (1 - done / steps)
            back = (p @ weights.T) / size
            weights -= step * hidden.T @ p / len(part)
            bias -= step * p.mean(axis=0)
            for d in range(dims):
                emb[:, d] -= step * np.bincount(feature, back[owner, d], BUCKETS + 1)
            done += 1
    emb[BUCKETS] = 0
    known[BUCKETS] = 0
    model = Model(languages, np.concatenate([emb @ weights, known[:, None]], axis=1).astype(np.float32), bias)
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], np.array([y_of[labels[i]] for i in np.flatnonzero(held)], dtype=np.int64))
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Choose the temperature with the least negative log-likelihood, then the rejection threshold.

    Whole texts alone are too easy to tell how sure short texts are, so a short passage of each joins them.
    """
    if not len(y):
        return
    raws = [t.encode() for t in texts]
    rng = np.random.default_rng(11)
    starts = [int(rng.integers(0, max(1, len(x) - 8))) for x in raws]
    raws += [x[i : i + int(rng.integers(8, 60))] for x, i in zip(raws, starts, strict=True)]
    y = np.concatenate([y, y])
    raw, at = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raws])])
    parts = [model.logits(raw[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
    z, met = (np.concatenate(x) for x in zip(*parts, strict=True))
    best = (np.inf, 1.0)
    for t in np.geomspace(0.02, 20, 60):
        model.temperature = float(t)
        nll = -np.log(np.maximum(model.probabilities(z)[np.arange(len(y)), y], 1e-12)).mean()
        best = min(best, (nll, float(t)))
    model.temperature = best[1]
    p = model.probabilities(z)
    model.familiar = FAMILIAR * float(np.sort(met)[int(REJECTED_SHARE * len(met))])
    right = np.sort(p.max(axis=1)[p.argmax(axis=1) == y])
    if len(right):
        model.threshold = float(min(NEVER_REJECTED, CHANCE / len(model.languages), right[int(REJECTED_SHARE * len(right))]))


def held_out(doc_id: Column) -> Column:
    """A fifth of the documents, by a checksum of their ids; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from at most about per_language labelled documents of each language, chosen by a hash of doc_id and length; of long
    ones a part of SAMPLE_CHARS characters, begun by hash. What the driver gets is bounded in rows and in characters."""
    share_code(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([], [])
    grain = 1 << 20
    share = F.lit(0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(grain, -(-grain * per_language // n)))).otherwise(share)
    at = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1)  # where a long text's part begins
    part = F.substring("text", at.cast("int") + 1, F.lit(SAMPLE_CHARS)).alias("text")
    some = labelled.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(grain)) < share).select("doc_id", "lang", part)
    rows = some.limit(2 * per_language * len(counts)).toPandas()
    rows = rows[rows["text"].str.len() > 0].sort_values(["doc_id", "lang", "text"])
    return train(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The kept columns of docs (all, if not told) with lang_pred, score and rejected, from the whole texts alone.

    A null text or one without a letter is `und`, with score 0, and rejected. Columns of docs that have the names of the
    results are replaced.
    """
    share_code(docs.sparkSession)
    names = [c for c in keep or docs.columns if c not in OUT.names]
    shaped = docs.select(*names, F.col(text).alias("_text"))
    schema = T.StructType([*(shaped.schema[c] for c in names), *OUT.fields])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = utf8(batch.column("_text"))
            lang, score, met = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
            for i, j in chunks(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if model.languages:
                    z, met[i:j] = model.logits(part, at)
                    p = model.probabilities(z)
                    lang[i:j] = np.where(has_letter(part, at), p.argmax(axis=1), -1)
                    score[i:j] = np.where(lang[i:j] >= 0, p.max(axis=1), 0)
            named = np.array([*model.languages, UNKNOWN], dtype=object)[lang]
            values = {c: batch.column(c) for c in names}
            yield frame({**values, "lang_pred": pa.array(named, pa.string()), "score": score, "rejected": (lang < 0) | model.rejects(score, met)}, schema)

    return shaped.mapInArrow(lean(predict), schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    done = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return done.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


