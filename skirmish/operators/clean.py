"""Cleaning, match metadata and whole-match splits."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skirmish.functions.stats import any_of, finite, hash_bucket, number_of, row_id

LINEAGE = ("source_file", "source_row")
MODES = {1: "Solo", 2: "Duo", 4: "Squad"}
UNCHECKED = ("player_survive_time", "team_placement")  # their validity is a flag, not a reason to drop a row
SPLITS = ("train", "validation", "test")


def exact_dedup(rows: DataFrame, lineage: tuple[str, ...] = LINEAGE) -> DataFrame:
    """One row of each group that agrees in everything but lineage: the one with the smallest lineage."""
    keys = [c for c in rows.columns if c not in lineage]
    kept = rows.groupBy(*keys).agg(F.min(F.struct(*lineage)).alias("_lineage"))
    return kept.select(*keys, *(F.col(f"_lineage.{c}").alias(c) for c in lineage))


def identity_conflicts(rows: DataFrame, keys: tuple[str, ...] = ("match_id", "player_name")) -> DataFrame:
    """Keys that several rows share, with their number; a null in a key is no identity."""
    named = rows.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    return named.groupBy(*keys).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def quarantine(rows: DataFrame, keys: tuple[str, ...] = ("match_id", "player_name")) -> DataFrame:
    """rows without all variants of identities in conflict; rows with a null key never conflict."""
    return rows.join(identity_conflicts(rows, keys).select(*keys), list(keys), "left_anti").select(*rows.columns)


def invalid(rows: DataFrame, numeric: list[str]) -> Column:
    """A missing match, or a number that is negative or not finite, apart from the columns that have validity flags."""
    checked = [c for c in numeric if c not in UNCHECKED]
    bad = any_of([(F.col(c) < 0) | ~finite(F.col(c)) for c in checked])
    return F.col("match_id").isNull() | F.coalesce(bad, F.lit(False))


def clean(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """Exact duplicates, then identity conflicts, then invalid rows removed."""
    return quarantine(exact_dedup(rows)).where(~invalid(rows, numeric))


def removal_ledger(rows: DataFrame, numeric: list[str]) -> DataFrame:
    """(step, rows_before, removed, rows_after) of each cleaning step; before = removed + after."""
    exact = exact_dedup(rows)
    single = quarantine(exact)
    states = [("read", rows), ("exact_duplicate", exact), ("identity_conflict", single), ("invalid", single.where(~invalid(single, numeric)))]
    sizes = [df.agg(F.count(F.lit(1)).alias("rows_after")).select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows_after") for i, (name, df) in enumerate(states)]
    before = F.lag("rows_after").over(Window.orderBy("step_no"))  # four rows
    ledger = reduce(DataFrame.union, sizes).withColumn("rows_before", before).where("step_no > 0")
    return ledger.select("step_no", "step", "rows_before", (F.col("rows_before") - F.col("rows_after")).alias("removed"), "rows_after")


def mode_of(party_size: Column, modes: dict[int, str] | None = None) -> Column:
    """The mode's name; unknown sizes, and none, are Other."""
    out = None
    for size, name in (modes or MODES).items():
        out = (F if out is None else out).when(party_size == size, F.lit(name))
    return out.otherwise(F.lit("Other"))


def with_identity(rows: DataFrame) -> DataFrame:
    """rows with row_id and team_size_mode."""
    ids = row_id(*(F.col(c) for c in ("match_id", "player_name", *LINEAGE)))
    return rows.withColumn("row_id", ids).withColumn("team_size_mode", mode_of(F.col("party_size")))


def match_metadata(rows: DataFrame) -> DataFrame:
    """One row per match: roster, teams and their conflicts, largest survival time, dates, party sizes.

    Teams are aggregated first and matches from those, so no distinct aggregate has to expand the rows.
    """
    survival = F.col("player_survive_time")
    time = F.col("date").try_cast("timestamp_ntz")
    teams = rows.groupBy("match_id", "team_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("team_placement").alias("placements"), F.max("team_placement").alias("top"),
        F.max(F.when(finite(survival) & (survival >= 0), survival)).alias("longest"),
        F.min(time).alias("first"), number_of(time.isNull()).alias("undated"),
    )
    named = F.col("team_id").isNotNull()
    roster = teams.groupBy("match_id").agg(
        F.sum("rows").alias("n_players"), number_of(named).alias("n_teams"), F.coalesce(F.sum(F.when(~named, F.col("rows"))), F.lit(0)).alias("missing_team_rows"),
        number_of(named & (F.col("placements") > 1)).alias("conflicting_teams"), F.max("top").alias("max_placement"),
        F.max("longest").alias("duration_proxy"), F.min("first").alias("match_time"), F.sum("undated").alias("bad_dates"),
    )
    values = lambda c, name: rows.where(F.col(c).isNotNull()).select("match_id", c).distinct().groupBy("match_id").agg(F.count(F.lit(1)).alias(name))
    out = roster.join(values("date", "dates"), "match_id", "left").join(values("party_size", "party_values"), "match_id", "left")
    return out.fillna(0, ["dates", "party_values"])


def chronology(metadata: DataFrame, declared: bool) -> str:
    """Grade A (matches have a time), B (days only) or C (no order): A and B need declared evidence, one date per match, no bad
    dates and at least three blocks."""
    r = metadata.agg(
        F.max("dates").alias("most"), F.sum("bad_dates").alias("bad"), F.count_distinct("match_time").alias("blocks"),
        F.coalesce(F.bool_and(F.col("match_time") == F.date_trunc("day", "match_time").cast("timestamp_ntz")), F.lit(False)).alias("midnights"),
    ).first()
    if not declared or r["most"] != 1 or r["bad"] or r["blocks"] < 3:
        return "C"
    return "B" if r["midnights"] else "A"


def block_split(blocks: DataFrame, block: str, size: str, ratios: tuple[float, float, float]) -> DataFrame:
    """(block, split): whole blocks in order, cut where their cumulative sizes first reach the ratios; every split gets one.

    blocks is one row per distinct time, which is small next to the rows; only the running sum needs their order.
    """
    run = Window.orderBy(block)
    sized = blocks.select(block, F.col(size).alias("_s"), (F.row_number().over(run) - 1).alias("_i"), F.sum(size).over(run).alias("_c"))
    total = F.sum("_s").over(Window.partitionBy())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    below = lambda share: F.sum((F.col("_c") < share * F.col("_total")).cast("long")).over(Window.partitionBy())
    sized = sized.withColumn("_total", total).withColumn("_n", n)
    cuts = sized.withColumn("_cut1", F.least(F.greatest(F.lit(1), below(ratios[0]) + 1), F.col("_n") - 2)).withColumn("_b2", below(ratios[0] + ratios[1]) + 1)
    cuts = cuts.withColumn("_cut2", F.least(F.greatest(F.col("_cut1") + 1, F.col("_b2")), F.col("_n") - 1))
    return cuts.select(block, F.when(F.col("_i") < F.col("_cut1"), SPLITS[0]).when(F.col("_i") < F.col("_cut2"), SPLITS[1]).otherwise(SPLITS[2]).alias("split"))


def split_matches(metadata: DataFrame, grade: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """(match_id, split). Grades A and B split by time or day; grade C permutes the matches in the order of their ids."""
    if grade == "C":
        ids = [r[0] for r in metadata.select("match_id").orderBy("match_id").collect()]  # one id per match
        order = np.random.default_rng(seed).permutation(len(ids))
        a, b = int(len(ids) * ratios[0]), int(len(ids) * (ratios[0] + ratios[1]))
        named = [(ids[j], SPLITS[0 if i < a else 1 if i < b else 2]) for i, j in enumerate(order)]
        return metadata.sparkSession.createDataFrame(named, f"match_id {metadata.schema['match_id'].dataType.simpleString()}, split string")
    time = F.col("match_time") if grade == "A" else F.date_trunc("day", "match_time").cast("timestamp_ntz")
    timed = metadata.select("match_id", time.alias("_block"))
    blocks = timed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    if blocks.limit(3).count() < 3:
        raise ValueError("a chronological split needs at least three blocks")
    return timed.join(block_split(blocks, "_block", "_n", ratios), "_block").select("match_id", "split")


def hash_split(match_id: Column, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)) -> Column:
    """A split by the match's hash, for tables too large for a permutation: no rows are collected."""
    b = hash_bucket(match_id, 10_000)
    return F.when(b < ratios[0] * 10_000, SPLITS[0]).when(b < (ratios[0] + ratios[1]) * 10_000, SPLITS[1]).otherwise(SPLITS[2])


def assert_row_count(joined: DataFrame, before: DataFrame) -> None:
    """Fail if a many-to-one join lost or multiplied rows."""
    a, b = before.count(), joined.count()
    if a != b:
        raise ValueError(f"a join changed the number of rows from {a} to {b}")
