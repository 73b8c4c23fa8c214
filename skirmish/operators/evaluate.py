"""Metrics by row, match and team, paired comparisons, a match-cluster bootstrap and error slices."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skirmish.functions.stats import finite, number_of

METRICS = ("mae", "rmse", "r2")


def check_predictions(p: DataFrame) -> None:
    """Fail on an empty table, on null or non-finite numbers, and on repeated row ids."""
    bad = ~F.coalesce(finite(F.col("actual")) & finite(F.col("predicted")), F.lit(False)) | F.col("row_id").isNull()
    r = p.agg(F.count(F.lit(1)).alias("n"), number_of(bad).alias("bad")).first()
    if not r["n"] or r["bad"]:
        raise ValueError("predictions are empty, or some are null or not finite")
    if not p.groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("a row has several predictions")


def metrics(p: DataFrame, weight: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """n, mae, rmse and r2, weighted if wanted. r2 is null for one row or a constant target.

    Squares are taken about an anchor, the mean of all rows, and corrected for each group's own mean: the sums stay as accurate
    as centred ones, and no group's mean has to be joined back to its rows.
    """
    anchor = p.agg(F.avg("actual").alias("m")).first()["m"] or 0.0
    w = weight if weight is not None else F.lit(1.0)
    e, y = F.col("actual") - F.col("predicted"), F.col("actual") - F.lit(anchor)
    sums = p.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w"), F.sum(w * F.abs(e)).alias("_abs"), F.sum(w * e * e).alias("_sq"), F.sum(w * y).alias("_y"), F.sum(w * y * y).alias("_yy"),
        (F.min("actual") < F.max("actual")).alias("_varied"),
    )
    total = F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_w")
    r2 = F.when((F.col("n") > 1) & F.col("_varied"), 1 - F.try_divide(F.col("_sq"), total))
    return sums.select(*(by or []), "n", F.try_divide(F.col("_abs"), F.col("_w")).alias("mae"), F.sqrt(F.try_divide(F.col("_sq"), F.col("_w"))).alias("rmse"), r2.alias("r2"))


def micro(p: DataFrame) -> DataFrame:
    return metrics(p)


def match_aware(p: DataFrame) -> DataFrame:
    """Every match weighs the same. Match sizes are pre-aggregated and joined, so a large match needs no window."""
    sizes = p.groupBy("match_id").agg(F.count(F.lit(1)).alias("_size"))
    return metrics(p.join(sizes, "match_id"), 1.0 / F.col("_size"))


def teams(p: DataFrame) -> DataFrame:
    """One row per team with its mean prediction. A team with several actual values is an error when the rows are used."""
    t = p.where(F.col("team_id").isNotNull()).groupBy("match_id", "team_id").agg(F.min("actual").alias("_lo"), F.max("actual").alias("_hi"), F.avg("predicted").alias("predicted"))
    wrong = F.raise_error(F.lit("a team has conflicting actual values")).cast("double")
    return t.select("match_id", "team_id", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(wrong).alias("actual"), "predicted")


def team_aware(p: DataFrame) -> DataFrame:
    return metrics(teams(p))


def hierarchical(p: DataFrame, placement: bool = True) -> DataFrame:
    """Metrics by aggregation: micro, match_aware and, for placement targets, team_aware."""
    kinds = [("micro", micro), ("match_aware", match_aware)] + ([("team_aware", team_aware)] if placement else [])
    return reduce(DataFrame.unionByName, [f(p).select(F.lit(k).alias("aggregation"), "n", *METRICS) for k, f in kinds])


def paired(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Both predictions of each row; rows that lack a partner or differ in identity or actual value are an error."""
    same = ["match_id", "team_id", "team_size_mode", "split", "actual"]
    b = candidate.select("row_id", F.col("predicted").alias("predicted_b"), *(F.col(c).alias(f"_{c}") for c in same))
    both = reference.select("row_id", *same, F.col("predicted").alias("predicted_a")).join(b, "row_id", "full")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    wrong = F.raise_error(F.lit("the two tables are not about the same rows")).cast("string")
    checked = both.withColumn("row_id", F.when(F.col("predicted_a").isNull() | F.col("predicted_b").isNull() | differs, wrong).otherwise(F.col("row_id")))
    return checked.drop(*(f"_{c}" for c in same))


def deltas(pairs: DataFrame, placement: bool = True) -> DataFrame:
    """(aggregation, metric, reference, candidate, delta), delta being candidate less reference."""
    sides = [hierarchical(pairs.withColumnRenamed(f"predicted_{s}", "predicted"), placement) for s in "ab"]
    long = [h.select("aggregation", F.explode(F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m))))).alias("metric", "value")) for h in sides]
    both = long[0].withColumnRenamed("value", "reference").join(long[1].withColumnRenamed("value", "candidate"), ["aggregation", "metric"])
    return both.withColumn("delta", F.col("candidate") - F.col("reference"))


def bootstrap_state(pairs: DataFrame) -> DataFrame:
    """One row per match of what any resample of matches can be scored from: rows, sum and squares of the actual values less
    the least of all, the difference of the absolute errors, and the squared errors of both sides. One aggregation."""
    least = pairs.agg(F.min("actual").alias("m")).first()["m"]
    y, ea, eb = F.col("actual") - F.lit(least), F.col("actual") - F.col("predicted_a"), F.col("actual") - F.col("predicted_b")
    return pairs.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("total"), F.sum(y * y).alias("squares"), F.sum(F.abs(eb) - F.abs(ea)).alias("gained"), F.sum(ea * ea).alias("reference"), F.sum(eb * eb).alias("candidate"))


def bootstrap(pairs: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(metric, lower, upper, valid_replicates, replicates, seed, level): 95 % percentile intervals of the deltas under
    resampling of whole matches. A replicate whose actual values are all equal has no r2.

    The driver holds six numbers per match, as the result follows one generator's draws over all matches, sorted by id.
    """
    if replicates < 20:
        raise ValueError("at least 20 replicates are needed")
    s = bootstrap_state(pairs).orderBy("match_id").toPandas().drop(columns="match_id").to_numpy(dtype=float)
    rng, out = np.random.default_rng(seed), np.full((replicates, len(METRICS)), np.nan)
    for i in range(replicates if len(s) else 0):
        drawn = np.bincount(rng.integers(0, len(s), len(s)), minlength=len(s))
        n, total, squares, gained, a, b = drawn @ s
        spread = squares - total * total / n
        out[i] = gained / n, np.sqrt(b / n) - np.sqrt(a / n), (a - b) / spread if spread > 1e-12 * squares else np.nan
    rows = []
    for name, x in zip(METRICS, out.T, strict=True):
        x = x[np.isfinite(x)]
        ends = np.quantile(x, [0.025, 0.975]).tolist() if len(x) else [None, None]
        rows.append((name, *ends, len(x), replicates, seed, "match"))
    return pairs.sparkSession.createDataFrame(rows, "metric string, lower double, upper double, valid_replicates int, replicates int, seed int, level string")


def region(edges: list[float]) -> Column:
    """The right-closed interval of the actual value between inner edges; the outer ones are open."""
    inner = sorted(set(edges))[1:-1]
    out = F.lit(len(inner))
    for i, e in reversed(list(enumerate(inner))):
        out = F.when(F.col("actual") <= e, i).otherwise(out)
    return out


def error_slices(p: DataFrame, edges: list[float]) -> DataFrame:
    """(slice, value, n, mae, rmse, r2) by mode, and by region of the actual value."""
    by_mode = metrics(p, by=["team_size_mode"]).select(F.lit("team_size_mode").alias("slice"), F.col("team_size_mode").alias("value"), "n", *METRICS)
    named = p.withColumn("target_region", region(edges).cast("string"))
    return by_mode.unionByName(metrics(named, by=["target_region"]).select(F.lit("target_region").alias("slice"), F.col("target_region").alias("value"), "n", *METRICS))


def residual_histogram(p: DataFrame, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, n): equal-width right-closed bins, the first opened downward by a thousandth of the range."""
    r = p.agg(F.min("residual").alias("lo"), F.max("residual").alias("hi")).first()
    if r["lo"] is None:
        return p.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    lo, hi = (r["lo"], r["hi"]) if r["lo"] < r["hi"] else (r["lo"] - 0.001 * (abs(r["lo"]) or 1), r["hi"] + 0.001 * (abs(r["hi"]) or 1))
    edges = [lo + (hi - lo) * i / bins for i in range(bins)] + [hi]
    at = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        at = F.when(F.col("residual") > e, i).otherwise(at)
    counts = p.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges[0] -= 0.001 * (hi - lo) if r["lo"] < r["hi"] else 0
    every = p.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, lower double, upper double")
    return every.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def plot_sample(p: DataFrame, most: int = 1500) -> DataFrame:
    """At most `most` rows for plots, the same ones every time: those with the least hash of their row id."""
    return p.orderBy(F.xxhash64("row_id"), "row_id").limit(most)


