"""Event timing: when in a match a player's credited kills happened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions.stats import finite, guarded, number_of

MINIMUM_DURATION = 60.0
STATUSES = ("confirmed_no_kill", "event_missing", "absolute_only", "phase_observed")


def eligible_events(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """Exact duplicates removed, in known matches, by a named killer other than the victim, at a finite time from 0 on.

    Events that differ in any column, canonical or raw, are different events. A null victim is allowed.
    """
    lineage = [c for c in ("source_file", "source_row") if c in events.columns]
    distinct = events.drop(*lineage).dropDuplicates()
    time = F.col("event_time")
    credited = F.col("killer_name").isNotNull() & F.coalesce(F.col("killer_name") != F.col("victim_name"), F.lit(True))
    return distinct.join(metadata.select("match_id", "duration_proxy"), "match_id").where(credited & finite(time) & (time >= 0))


def timing(events: DataFrame, metadata: DataFrame, minimum: float = MINIMUM_DURATION) -> DataFrame:
    """One row per (match, killer): counts, first and mean time, and counts by third of the match.

    Thirds need a finite duration of at least the minimum and an event not after it; other events count in absolute terms.
    """
    d, t = F.col("duration_proxy"), F.col("event_time")
    usable = F.coalesce(finite(d) & (d >= minimum) & (t <= d), F.lit(False))
    rel = F.when(usable, t / d)
    return eligible_events(events, metadata).withColumn("_rel", rel).groupBy("match_id", "killer_name").agg(
        F.count(F.lit(1)).alias("event_kills"), F.min("event_time").alias("first_kill_time"), (F.sum("event_time") / F.count("event_time")).alias("avg_kill_time"),
        F.count("_rel").alias("phase_valid_events"), number_of(F.col("_rel") < 1 / 3).alias("early_kills"),
        number_of((F.col("_rel") >= 1 / 3) & (F.col("_rel") < 2 / 3)).alias("mid_kills"), number_of(F.col("_rel") >= 2 / 3).alias("late_kills"),
    )


def with_timing(base: DataFrame, times: DataFrame) -> DataFrame:
    """base with timing columns and timing_status, one row for each of base's.

    Phase counts are 0 for players who are known to have no kill, null where they could not be observed.
    """
    c = F.col
    t = times.select("match_id", c("killer_name").alias("player_name"), *(c(x).alias(f"_{x}") for x in times.columns if x not in ("match_id", "killer_name")))
    joined = base.join(t, ["match_id", "player_name"], "left")
    none, seen = c("_event_kills").isNull(), c("_phase_valid_events") > 0
    no_kill = none & F.coalesce(c("player_kills") == 0, F.lit(False))
    status = F.when(no_kill, STATUSES[0]).when(none, STATUSES[1]).when(~seen, STATUSES[2]).otherwise(STATUSES[3])
    phase = {f"{p}_kills": F.when(no_kill, F.lit(0)).when(seen, c(f"_{p}_kills")) for p in ("early", "mid", "late")}
    ratio = {f"{p}_kill_ratio": guarded(c(f"_{p}_kills"), c("_phase_valid_events")) for p in ("early", "mid", "late")}
    out = joined.withColumns({
        "event_kills": c("_event_kills"), "first_kill_time": c("_first_kill_time"), "avg_kill_time": c("_avg_kill_time"), "has_kill": F.when(c("player_kills") > 0, 1).when(c("player_kills") == 0, 0),
        "phase_valid_events": F.when(no_kill, F.lit(0)).otherwise(c("_phase_valid_events")), **phase, **ratio, "timing_status": status,
    })
    return out.drop(*(x for x in out.columns if x.startswith("_")))


def time_unit(told: dict) -> dict:
    """What is known of the source's time unit: accepted when it is verified by evidence, or when seconds are assumed, with
    evidence, for exactly the source and version that the approval names. An assumption is never called verified."""
    status, evidence = told.get("status", "pending"), (told.get("evidence") or "").strip()
    if status not in ("pending", "verified", "assumed_seconds"):
        raise ValueError(f"unknown status of the time unit: {status}")
    source = f"{told.get('dataset')}/versions/{told.get('version')}"
    assumed = status == "assumed_seconds"
    approved = assumed and told.get("approved") is True and told.get("version") is not None and told.get("scope") == source
    accepted = bool(evidence) and (status == "verified" or approved)
    return {"status": status, "accepted": accepted, "verified": accepted and status == "verified", "unit": "unknown" if status == "pending" else "seconds", "evidence": evidence, "source": source}


def coverage(joined: DataFrame, by: str = "team_size_mode") -> DataFrame:
    """Rows and their share by mode and timing status."""
    from pyspark.sql import Window

    counts = joined.groupBy(by, "timing_status").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(by)))


def discrepancy(joined: DataFrame) -> DataFrame:
    """Per row, aggregate kills less event kills (none counting 0)."""
    diff = F.col("player_kills") - F.coalesce(F.col("event_kills"), F.lit(0))
    return joined.select("match_id", "player_name", "team_size_mode", "timing_status", diff.alias("kill_difference"))


def discrepancy_summary(joined: DataFrame) -> DataFrame:
    d = F.col("kill_difference")
    return discrepancy(joined).groupBy("timing_status").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(d)).alias("mean_abs_difference"), number_of(d == 0).alias("agreeing"))


def phase_summary(joined: DataFrame) -> DataFrame:
    """By mode, over rows whose phases were observed: events by third and mean ratios."""
    seen = joined.where(F.col("timing_status") == STATUSES[3])
    return seen.groupBy("team_size_mode").agg(
        F.count(F.lit(1)).alias("rows"), *(F.sum(f"{p}_kills").alias(f"{p}_kills") for p in ("early", "mid", "late")), *(F.avg(f"{p}_kill_ratio").alias(f"{p}_ratio") for p in ("early", "mid", "late"))
    )


def event_diagnostics(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """How many raw events have each shortcoming; an event may have several."""
    c = F.col
    e = events.join(metadata.select("match_id", "duration_proxy", F.lit(1).alias("_known")), "match_id", "left")
    return e.agg(
        F.count(F.lit(1)).alias("events"), number_of(c("match_id").isNull()).alias("no_match"), number_of(c("_known").isNull()).alias("orphans"),
        number_of(c("killer_name").isNull()).alias("no_killer"), number_of(c("victim_name").isNull()).alias("no_victim"), number_of(c("killer_name") == c("victim_name")).alias("self_kills"),
        number_of(c("event_time").isNull() | ~finite(c("event_time"))).alias("no_time"), number_of(c("event_time") < 0).alias("negative_time"),
        number_of(c("event_time") > c("duration_proxy")).alias("after_end"), number_of(c("duration_proxy") < MINIMUM_DURATION).alias("short_match"),
    )
