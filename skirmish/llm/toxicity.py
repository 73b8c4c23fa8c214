"""Toxicity by a classifier chain.

Categories are predicted one after another by linear models; each model sees the words of the text and the probabilities of
the categories before it. In training those probabilities are out-of-fold, so that a later model learns from predictions as
unsure as it will meet. The last link is toxicity as such, learned from the labels. The categories before it have no labels
of their own: a text labelled toxic counts as of a category when it holds one of the category's seed words. All categories
are in the chain; one that no labelled text is of has probabilities near 0.

Features are words and word beginnings that are significantly commoner in toxic than in other labelled texts; beginnings
catch inflected forms that training never met. Training takes a bounded sample of
the labelled rows; prediction reads whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.common import frame, lean, slices
from skirmish.session import share_code

SAMPLE = 8_000  # the most labelled documents that training takes
FOLDS = 5  # of out-of-fold predictions
# Seed words of the categories.
SEEDS = {
    "insult": "idiot moron stupid clown fool dumb imbecile dimwit loser pathetic",
    "contempt": "trash scum worthless garbage filth vermin useless parasite",
    "obscenity": "disgusting damn crap bastard bitch shit fuck asshole",
    "threat": "kill hurt destroy murder burn attack shoot",
    "hate": "hate inferior subhuman savages infest deport exterminate",
}
CATEGORIES = [*SEEDS, "toxic"]
_WORD = re.compile(r"[^\W\d_]+")


BEGINNINGS = (4, 5, 6, 7)  # lengths; longer words have them as features of their own, marked with a star


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(text: str | None) -> set[str]:
    words = words_of(text)
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


@dataclass
class Marks:
    """A matrix of zeros and ones by the places of its ones."""

    row: np.ndarray
    column: np.ndarray
    rows: int
    columns: int

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.column], self.rows)

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """By column, the sum of the weights of its rows."""
        return np.bincount(self.column, weight[self.row], self.columns)

    def where(self, keep: np.ndarray) -> Marks:
        inside = keep[self.row]
        return Marks((np.cumsum(keep) - 1)[self.row[inside]], self.column[inside], int(keep.sum()), self.columns)


@dataclass
class Link:
    category: str
    weights: np.ndarray  # of the words, then of the earlier categories' probabilities
    bias: float

    def probability(self, x: Marks, earlier: np.ndarray) -> np.ndarray:
        z = x.times(self.weights[: x.columns]) + earlier @ self.weights[x.columns :] + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass
class Chain:
    words: list[str]  # a feature each
    links: list[Link]
    threshold: float = 0.5

    def features(self, texts: list[str | None]) -> Marks:
        at = {w: i for i, w in enumerate(self.words)}
        known = set(at)
        found = [sorted(at[w] for w in known & features_of(t)) for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        return Marks(row, np.array([c for f in found for c in f], dtype=np.int64), len(texts), len(at))

    def predict(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        x = self.features(texts)
        earlier = np.zeros((len(texts), 0))
        out = {}
        for link in self.links:
            out[link.category] = link.probability(x, earlier)
            earlier = np.column_stack([earlier, out[link.category]])
        return out


def logistic(x: Marks, earlier: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> tuple[np.ndarray, float]:
    """Penalised logistic regression by Newton steps; earlier: a few dense columns beside the marks."""
    dense = np.column_stack([earlier, np.ones(x.rows)])
    k = x.columns
    w = np.zeros(k + dense.shape[1])
    if not y.any():  # nothing to tell from: never
        return w[:-1], -500.0
    ridge = np.append(np.full(len(w) - 1, penalty), 1e-6)
    times = lambda v: x.times(v[:k]) + dense @ v[k:]
    sums = lambda u: np.concatenate([x.sums(u), dense.T @ u])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(times(w), -500, 500)))
        s = np.maximum(p * (1 - p), 1e-6)
        diagonal = np.concatenate([x.sums(s), (dense * dense).T @ s]) + ridge
        step = _solved(lambda v, s=s: sums(s * times(v)) + ridge * v, sums(y - p) - ridge * w, diagonal)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _solved(product: Callable[[np.ndarray], np.ndarray], b: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """The solution of a positive definite system, by preconditioned conjugate gradients: no matrix of its size is made."""
    v, r = np.zeros(len(b)), b.copy()
    z = r / diagonal
    d, rz = z.copy(), r @ z
    small = 1e-16 * rz
    for _ in range(2 * len(b)):
        if rz <= small:
            break
        q = product(d)
        a = rz / (d @ q)
        v, r = v + a * d, r - a * q
        z = r / diagonal
        d, rz = z + (r @ z) / rz * d, r @ z
    return v


def significant(texts: list[str | None], y: np.ndarray) -> list[str]:
    """Features commoner in texts with y = 1, by their log-likelihood ratio, best first. The least ratio follows from how many
    features are tried, so that about one is there by chance, however many texts there are. Only features of texts with y = 1
    are counted, and texts are read one by one, so that memory stays bounded by them."""
    pos, neg = Counter(), Counter()
    for t, v in zip(texts, y, strict=True):
        if v:
            pos.update(features_of(t))
    pos = Counter({w: a for w, a in pos.items() if a > 1})
    for t, v in zip(texts, y, strict=True):
        if not v:
            neg.update(pos.keys() & features_of(t))
    least = 2 * np.log(max(2, len(pos)))
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    scored = []
    for w, a in pos.items():
        b = neg[w]
        e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        if a > e1 and (g := 2 * (a * np.log(a / e1) + (b * np.log(b / e0) if b else 0))) >= least:
            scored.append((-g, w))
    return [w for _, w in sorted(scored)]


def train(texts: list[str | None], toxic: np.ndarray, seed: int = 3) -> Chain:
    """A chain from labelled texts; without toxic or without other texts it finds nothing toxic."""
    y = np.asarray(toxic, dtype=float)
    if not len(y) or y.min() == y.max():
        return Chain([], [Link("toxic", np.zeros(0), -500.0)])
    chain = Chain(significant(texts, y), [])
    x = chain.features(texts)
    fold = np.random.default_rng(seed).integers(0, FOLDS, len(y))
    earlier = np.zeros((len(y), 0))
    seeds = {c: set(words.split()) for c, words in SEEDS.items()}
    every = set().union(*seeds.values())
    held = [words_of(t) & every if v else set() for t, v in zip(texts, y, strict=True)]
    for category in CATEGORIES:
        target = y if category == "toxic" else np.array([bool(s & seeds[category]) for s in held], dtype=float)
        unseen = np.full(len(y), target.mean())
        for k in range(FOLDS):
            if 0 < target[fold != k].sum() < (fold != k).sum() and (fold == k).any():
                w, b = logistic(x.where(fold != k), earlier[fold != k], target[fold != k])
                unseen[fold == k] = Link(category, w, b).probability(x.where(fold == k), earlier[fold == k])
        chain.links.append(Link(category, *logistic(x, earlier, target)))
        earlier = np.column_stack([earlier, unseen])
    return chain


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """A chain from at most about `sample` labelled documents, chosen by a hash of their ids."""
    share_code(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return train([], np.zeros(0))
    grain = 1 << 20
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < min(grain, -(-grain * sample // n))).limit(2 * sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").limit(2 * sample).toPandas().sort_values(["doc_id", "text"])
    return train(rows["text"].tolist(), rows["toxic"].to_numpy())


def judge(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, toxic, score, p_<category>...) of every row. A null or empty text isn't toxic; repeated rows are judged alike,
    and long texts whole. Where nothing could be learned, categories have a null probability."""
    share_code(docs.sparkSession)
    middle = [T.StructField(f"p_{c}", T.DoubleType()) for c in CATEGORIES[:-1]]
    schema = T.StructType([docs.schema["doc_id"], T.StructField("toxic", T.BooleanType()), T.StructField("score", T.DoubleType()), *middle])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            p = chain.predict(b.column("text").to_pylist())
            none = pa.nulls(b.num_rows, pa.float64())
            values = {f.name: p.get(f.name[2:], none) for f in middle}
            yield frame({"doc_id": b.column("doc_id"), "toxic": p["toxic"] >= chain.threshold, "score": p["toxic"], **values}, schema)

    return docs.select("doc_id", "text").mapInArrow(lean(read), schema)
