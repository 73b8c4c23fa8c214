"""K-means with restarts, its diagnostics, and tables of what the clusters hold."""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEEDS = (42, 43, 44)
SAMPLE = 2000


def k_means(rows: DataFrame, k: int, seed: int, restarts: int = 10, vector: str = "z") -> KMeansModel:
    """The model with the least cost of several restarts over all rows; rows has an array column of scaled features."""
    data = rows.select(array_to_vector(F.col(vector)).alias("features")).persist()
    try:
        fits = [KMeans(k=k, seed=seed + 1000 * i, maxIter=100, tol=1e-6).fit(data) for i in range(restarts)]
    finally:
        data.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def labelled(rows: DataFrame, model: KMeansModel, vector: str = "z") -> DataFrame:
    out = model.transform(rows.withColumn("features", array_to_vector(F.col(vector))))
    return out.withColumnRenamed("prediction", "cluster").drop("features")


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def centers(rows: DataFrame, vector: str = "z", label: str = "cluster") -> DataFrame:
    """(cluster, n, center)."""
    each = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "m")))
    return each.groupBy(label).agg(F.max("n").alias("n"), F.transform(ordered, lambda p: p["m"]).alias("center"))


def davies_bouldin(rows: DataFrame, vector: str = "z", label: str = "cluster") -> float:
    """Mean over clusters of the worst (scatter + scatter) / distance; 0 if there is no scatter or all centres coincide."""
    c = centers(rows, vector, label)
    spread = rows.join(F.broadcast(c.select(label, "center")), label).groupBy(label).agg(F.avg(_distance(F.col(vector), F.col("center"))).alias("s"))  # k centres
    found = c.join(spread, label).orderBy(label).collect()
    m, s = np.array([r["center"] for r in found]), np.array([r["s"] for r in found])
    d = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2))
    if np.allclose(s, 0) or np.allclose(d, 0):
        return 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (s[:, None] + s[None]) / np.where(d == 0, np.inf, d)
    np.fill_diagonal(ratio, 0)
    return float(ratio.max(axis=1).mean())


def adjusted_rand(rows: DataFrame, a: str, b: str) -> float:
    """Agreement of two labellings, corrected for chance, from their contingency table."""
    table = [(r["a"], r["b"], r["n"]) for r in rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()]
    n = sum(x for _, _, x in table)
    side = lambda i: sum(comb(sum(x for *k, x in table if k[i] == v), 2) for v in {t[i] for t in table})
    both, ra, rb, all_ = sum(comb(x, 2) for _, _, x in table), side(0), side(1), comb(n, 2)
    expected, most = (ra * rb / all_ if all_ else 0), (ra + rb) / 2
    return 1.0 if most == expected else (both - expected) / (most - expected)


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette with Euclidean distances, of a sample that fits in memory; members of singletons count 0."""
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0)) if len(x) <= 512 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    kinds = np.unique(labels)
    mean = np.stack([d[:, labels == k].sum(axis=1) for k in kinds], axis=1)
    size = np.array([(labels == k).sum() for k in kinds])
    own = np.searchsorted(kinds, labels)
    at = np.arange(len(x))
    inside = mean[at, own] / np.maximum(size[own] - 1, 1)
    other = mean / size
    other[at, own] = np.inf
    near = other.min(axis=1)
    s = np.where(size[own] > 1, (near - inside) / np.maximum(np.maximum(near, inside), 1e-300), 0)
    return float(s.mean())


def sample_of(rows: DataFrame, key: str, most: int = SAMPLE) -> DataFrame:
    """At most `most` rows, the same ones every time."""
    return rows.orderBy(F.xxhash64(key), key).limit(most)


@dataclass
class Diagnosis:
    k: int
    inertia: float
    silhouette: float
    davies_bouldin: float
    stability: float
    least_share: float


def diagnose(rows: DataFrame, key: str, ks: range = range(2, 9), seeds: tuple[int, ...] = SEEDS, restarts: int = 10) -> list[Diagnosis]:
    """For each k below the number of rows: cost, silhouette and Davies-Bouldin of the first seed's labels, their mean
    adjusted Rand index with the other seeds' labels, and the smallest cluster's share."""
    n, out = rows.count(), []
    few = sample_of(rows, key)
    for k in ks:
        if k >= n:
            continue
        models = [k_means(rows, k, s, restarts) for s in seeds]
        first = labelled(rows, models[0])
        pdf = labelled(few, models[0]).select("z", "cluster").toPandas()
        agree = [adjusted_rand(labelled(first.withColumnRenamed("cluster", "_first"), m), "_first", "cluster") for m in models[1:]]
        sizes = [r["n"] for r in first.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()]
        labels = pdf["cluster"].to_numpy()
        score = silhouette(np.array(pdf["z"].tolist()), labels) if len(set(labels)) > 1 else float("nan")
        out.append(Diagnosis(k, models[0].summary.trainingCost, score, davies_bouldin(first), float(np.mean(agree)) if agree else 1.0, min(sizes) / n))
    return out


def choose(diagnoses: list[Diagnosis], wanted: int | None = None) -> int:
    """The wanted number if given, else the one with the greatest finite silhouette, the smaller of equals."""
    if wanted is not None:
        return wanted
    fit = [d for d in diagnoses if np.isfinite(d.silhouette)]
    if not fit:
        raise ValueError("no number of clusters has a finite silhouette")
    return min(fit, key=lambda d: (-d.silhouette, d.k)).k


def cluster_tables(rows: DataFrame, features: list[str], outcomes: list[str], by: str = "team_size_mode") -> DataFrame:
    """By mode and cluster: size, share within the mode, means of the raw features and outcomes."""
    from pyspark.sql import Window

    sized = rows.groupBy(by, "cluster").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"mean_{c}") for c in [*features, *outcomes]))
    return sized.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))
