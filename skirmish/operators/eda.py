"""Exact distribution statistics and relationships over train and validation rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.stats import any_of, finite, if_finite, pearson
from skirmish.session import checkpoint

BINS = 30
DEVELOPMENT = ("train", "validation")


def development(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("split").isin(*DEVELOPMENT))


def value_counts(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, value, n): how often each value occurs, written once, as the readers below go over it more than once."""
    return checkpoint(rows.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def positions(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts with `before`, how many of the group's values are smaller.

    Values are dealt by range, so a part holds its share of the distinct values, whatever the groups' sizes; it adds up its
    own counts, and what precedes it is a sum over one row per part and group.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpoint(counts.repartitionByRange(parts, *by, "value").withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = dealt.groupBy(*by, "_part").agg(F.sum("n").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    before = F.col("_start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return dealt.join(start, [*by, "_part"]).select(*by, "value", "n", before.alias("before"))


def order_statistics(counts: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """(by, names of shares): the quantiles of each group, interpolated between the neighbouring order statistics."""
    placed = positions(counts, by)
    sized = placed.join(counts.groupBy(*by).agg((F.sum("n") - 1).alias("_last")), by)
    place = {k: F.col("_last") * F.lit(float(p)) for k, p in shares.items()}
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    ends = [f(F.when(holds(g(h)), F.col("value"))).alias(f"{k}_{e}") for k, h in place.items() for e, f, g in (("lo", F.max, F.floor), ("hi", F.max, F.ceil))]
    found = sized.where(any_of([holds(g(h)) for h in place.values() for g in (F.floor, F.ceil)])).groupBy(*by, "_last").agg(*ends)
    lo = lambda k: F.col(f"{k}_lo")
    return found.select(*by, *((lo(k) + (F.col(f"{k}_hi") - lo(k)) * (h - F.floor(h))).alias(k) for k, h in place.items()))


def statistics(rows: DataFrame, columns: list[str], valid: dict[str, str] | None = None) -> DataFrame:
    """One row per column: n, valid, mean, median, std, min, max, quartiles, skewness, zeros and missing.

    valid names flag columns of those whose values only count where it is true. All columns share one scan: rows are unpivoted
    map-side to (column, value), reduced to counts of equal values, and everything else is read from those counts.
    """
    flag = valid or {}
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.when(F.col(flag[c]), F.col(c).cast("double")).otherwise(None).alias("value") if c in flag else F.col(c).cast("double").alias("value")) for c in columns))
    long = rows.select(F.explode(pairs).alias("p")).select("p.column", if_finite(F.col("p.value")).alias("value"))
    counts = value_counts(long, "value", ["column"])
    x, m = F.col("value"), F.col("n")
    plain = counts.groupBy("column").agg(
        F.sum(m).alias("rows"), F.coalesce(F.sum(F.when(x.isNotNull(), m)), F.lit(0)).alias("valid"), (F.sum(m * x) / F.sum(F.when(x.isNotNull(), m))).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.coalesce(F.sum(F.when(x == 0, m)), F.lit(0)).alias("zeros"), F.coalesce(F.sum(F.when(x.isNull(), m)), F.lit(0)).alias("missing"),
    )
    off = F.col("value") - F.col("mean")
    moments = counts.where("value IS NOT NULL").join(plain.select("column", "mean", "valid"), "column").groupBy("column", "valid").agg(F.sum(m * off * off).alias("s2"), F.sum(m * off * off * off).alias("s3"))
    n, var = F.col("valid"), F.col("s2") / F.col("valid")
    g1 = F.when(F.col("s2") > 0, F.col("s3") / n / (var * F.sqrt(var)))
    shape = moments.select("column", F.when(n > 1, F.sqrt(F.col("s2") / (n - 1))).alias("std"), F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0)).alias("skewness"))
    middle = order_statistics(counts.where("value IS NOT NULL"), ["column"], {"q25": 0.25, "median": 0.5, "q75": 0.75})
    out = plain.join(shape, "column", "left").join(middle, "column", "left")
    return out.select("column", F.col("rows").alias("n"), "valid", "mean", "median", "std", "min", "max", "q25", "q75", "skewness", "zeros", "missing")


def mode_statistics(rows: DataFrame, columns: list[str], by: str = "team_size_mode") -> DataFrame:
    """By mode: rows, and mean and sample deviation of each column."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        aggs += [F.avg(if_finite(F.col(c))).alias(f"{c}_mean"), F.stddev_samp(if_finite(F.col(c))).alias(f"{c}_std")]
    return rows.groupBy(by).agg(*aggs)


def histogram(rows: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, lower, n) of equal-width bins from the least to the greatest value, empty bins included."""
    x = rows.select(F.col(column).cast("double").alias("x")).where(finite(F.col("x")))
    r = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if r["lo"] is None:
        return rows.sparkSession.createDataFrame([], "bin int, lower double, n long")
    width = (r["hi"] - r["lo"]) / bins or 1.0
    at = F.least(F.lit(bins - 1), F.floor((F.col("x") - r["lo"]) / width)).cast("int").alias("bin")
    counts = x.groupBy(at).agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(r["lo"]) + F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def quantiles(rows: DataFrame, column: str, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Exact interpolated quantiles of a column's finite values; one row, of nulls where there are none."""
    x = rows.select(F.lit(0).alias("_g"), F.col(column).cast("double").alias("x")).where(finite(F.col("x")))
    found = order_statistics(value_counts(x, "x", ["_g"]), ["_g"], {f"q{round(p * 100)}": p for p in shares})
    return found.agg(*(F.max(f"q{round(p * 100)}").alias(f"q{round(p * 100)}") for p in shares))


def date_coverage(rows: DataFrame, time: str = "date") -> DataFrame:
    """Rows and matches by day."""
    return rows.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("match_id").alias("matches"))


def average_ranks(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by, value, n, rank) of each distinct value: ties share the mean of their positions. Only distinct values with their
    counts are ranked, part by part of the value range, so no task sees all values of a group."""
    keys = by or ["_g"]
    counts = value_counts(rows if by else rows.withColumn("_g", F.lit(0)), column, keys)
    return positions(counts, keys).select(*(by or []), "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def correlations(rows: DataFrame, targets: dict[str, str], features: list[str], by: str = "team_size_mode", ranks: bool = True) -> DataFrame:
    """(by, target, feature, n, pearson, spearman, status) over development rows with a valid target and both values finite.

    targets maps each target to its validity flag. Ranks are taken within each pair and group, over its own rows. The rows are
    unpivoted to pairs, reduced to counts of equal (x, y), and ranked by distinct value. Without ranks, there is one aggregation
    only, and neither spearman nor status.
    """
    rows = development(rows)
    pairs = F.array(*(
        F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("x"), F.when(F.col(flag), F.col(t).cast("double")).alias("y"))
        for t, flag in targets.items() for f in features
    ))
    long = rows.select(by, F.explode(pairs).alias("p")).select(by, "p.*").where(finite(F.col("x")) & finite(F.col("y")))
    key = [by, "target", "feature"]
    plain = lambda df: df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("pearson"))
    if not ranks:
        return plain(long)
    points = checkpoint(long.groupBy(*key, "x", "y").agg(F.count(F.lit(1)).alias("m")))  # all that follows reads it
    x, y, a, b, m, mid = (F.col(c) for c in ("x", "y", "rx", "ry", "m", "mid"))

    def rank(v: str) -> DataFrame:
        counts = checkpoint(points.groupBy(*key, F.col(v).alias("value")).agg(F.sum("m").alias("n")))
        return positions(counts, key).select(*key, F.col("value").alias(v), (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{v}"))

    means = points.groupBy(*key).agg(F.sum(m).alias("n"), ((F.sum(m) + 1) / 2).alias("mid"), (F.sum(m * x) / F.sum(m)).alias("mx"), (F.sum(m * y) / F.sum(m)).alias("my"))
    ranked = points.join(rank("x"), [*key, "x"]).join(rank("y"), [*key, "y"]).join(means, key)
    # moments about the means, where sums stay small
    u, v, a, b = x - F.col("mx"), y - F.col("my"), a - mid, b - mid
    of = lambda p, q: F.try_divide(F.sum(m * p * q), F.sqrt(F.sum(m * p * p)) * F.sqrt(F.sum(m * q * q)))
    out = ranked.groupBy(*key, "n").agg(of(u, v).alias("pearson"), of(a, b).alias("spearman"))
    return out.withColumn("status", F.when((F.col("n") >= 3) & F.col("spearman").isNotNull(), "ok").otherwise("undefined"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, Pearson and Spearman of two columns over rows where both are finite; scales to any number of distinct values."""
    pairs = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(finite(F.col("x")) & finite(F.col("y")))
    rx = average_ranks(pairs, "x").select(F.col("value").alias("x"), F.col("rank").alias("rx"))
    ry = average_ranks(pairs, "y").select(F.col("value").alias("y"), F.col("rank").alias("ry"))
    points = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("m")).join(rx, "x").join(ry, "y")
    wide = points.agg(F.sum("m").alias("n"), *(F.sum(F.col("m") * e).alias(k) for k, e in {
        "sx": F.col("x"), "sy": F.col("y"), "sa": F.col("rx"), "sb": F.col("ry"), "sab": F.col("rx") * F.col("ry"), "saa": F.col("rx") * F.col("rx"), "sbb": F.col("ry") * F.col("ry")}.items()))
    rank = F.try_divide(F.col("sab") - F.col("sa") * F.col("sb") / F.col("n"), F.sqrt(F.col("saa") - F.col("sa") ** 2 / F.col("n")) * F.sqrt(F.col("sbb") - F.col("sb") ** 2 / F.col("n")))
    plain = pairs.agg(pearson(F.col("x"), F.col("y")).alias("pearson")).first()
    return wide.select("n", F.lit(plain["pearson"]).cast("double").alias("pearson"), rank.alias("spearman"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) of numbers, with exact quartiles."""
    found = statistics(rows, columns)
    return found.select("column", F.col("valid").alias("count"), "mean", "std", "min", "q25", F.col("median").alias("q50"), "q75", "max")


def describe_text(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, unique, top, freq) of text columns; of equally frequent values the smallest is top."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("p")).select("p.*").where("value IS NOT NULL")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("value")))
    return counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"), best.alias("b")).select("column", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.n")).alias("freq"))


def relationships(rows: DataFrame, targets: dict[str, str], features: list[str], phase: list[str], time_unit: str = "pending") -> DataFrame:
    """correlations over all modes together, as mode Overall, and each on its own, with what a reader should know of them.

    One pass: a row counts for Overall and for its mode. Phase features are not primary for survival time. Pairs of which no
    row is valid are there with n = 0. time_unit is the status of the source's time unit; coefficients have none.
    """
    both = rows.withColumn("mode", F.explode(F.array(F.lit("Overall"), F.col("team_size_mode"))))
    found = correlations(both, targets, features, by="mode")
    pairs = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature")) for t in targets for f in features))
    modes = rows.select(F.explode(F.array(F.lit("Overall"), F.col("team_size_mode"))).alias("mode")).distinct()
    every = modes.select("mode", F.explode(pairs).alias("p")).select("mode", "p.*")
    out = every.join(found, ["mode", "target", "feature"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "status": F.coalesce("status", F.lit("undefined"))})
    return out.withColumns({
        "analysis_scope": F.lit("train+validation"), "primary": ~((F.col("target") == "player_survive_time") & F.col("feature").isin(*phase)),
        "time_unit_status": F.lit(time_unit), "coefficient_unit": F.lit("dimensionless"),
    })
