"""Per-row features: validity flags, placement, ratios and rates; what each task may use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions.stats import finite, guarded, number_of

# The feature registry.
BASE = ["player_kills", "player_dmg", "damage_per_kill", "player_dist_walk", "player_dist_ride", "total_distance", "walk_ratio", "player_assists", "player_dbno", "assist_ratio"]
ABSOLUTE = ["first_kill_time", "avg_kill_time", "has_kill"]
PHASE = ["early_kills", "mid_kills", "late_kills", "early_kill_ratio", "mid_kill_ratio", "late_kill_ratio"]
TASKS = {"s1": BASE + ABSOLUTE, "p2": BASE + ABSOLUTE + PHASE, "t0": BASE}
TARGETS = {"s1": "player_survive_time", "p2": "normalized_placement", "t0": "normalized_placement"}
LEAKING = {"s1": ["player_survive_time", "team_placement", "normalized_placement", "kills_per_minute", "damage_per_minute", "walk_velocity", "ride_velocity", *PHASE], "p2": ["team_placement", "normalized_placement"], "t0": ["team_placement", "normalized_placement", *ABSOLUTE, *PHASE]}
MEANING = {
    "damage_per_kill": "player_dmg / player_kills", "total_distance": "player_dist_walk + player_dist_ride", "walk_ratio": "player_dist_walk / total_distance",
    "assist_ratio": "player_assists / (player_kills + player_assists)", "kills_per_minute": "60 * player_kills / player_survive_time", "damage_per_minute": "60 * player_dmg / player_survive_time",
    "walk_velocity": "player_dist_walk / player_survive_time", "ride_velocity": "player_dist_ride / player_survive_time", "normalized_placement": "1 - (team_placement - 1) / (n_teams - 1)",
}


def base_features(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows with metadata of their match, validity flags and derived columns. Undefined ratios are null."""
    c = F.col
    meta = metadata.select("match_id", "n_teams", "missing_team_rows", "conflicting_teams", "max_placement")
    t, kills, walk, ride = c("player_survive_time"), c("player_kills"), c("player_dist_walk"), c("player_dist_ride")
    survival = F.coalesce(finite(t) & (t >= 0), F.lit(False))
    placed = (c("n_teams") > 1) & (c("missing_team_rows") == 0) & (c("conflicting_teams") == 0) & (c("max_placement") <= c("n_teams")) & c("team_id").isNotNull() & c("team_placement").between(1, c("n_teams"))
    joined = rows.join(meta, "match_id").withColumn("valid_survival", survival).withColumn("valid_placement", F.coalesce(placed, F.lit(False)))
    total = walk + ride
    return joined.withColumns({
        "normalized_placement": F.when(c("valid_placement"), 1 - (c("team_placement") - 1) / F.nullif(c("n_teams") - 1, F.lit(0))),
        "damage_per_kill": guarded(c("player_dmg"), kills), "total_distance": total, "walk_ratio": guarded(walk, total),
        "assist_ratio": guarded(c("player_assists"), kills + c("player_assists")), "kills_per_minute": guarded(60 * kills, t), "damage_per_minute": guarded(60 * c("player_dmg"), t),
        "walk_velocity": guarded(walk, t), "ride_velocity": guarded(ride, t),
    })


def feature_validation(base: DataFrame) -> DataFrame:
    """One scan's summary: rows, flags, and values outside what the features can be."""
    c = F.col
    return base.agg(
        F.count(F.lit(1)).alias("rows"), number_of(c("valid_survival")).alias("valid_survival"), number_of(c("valid_placement")).alias("valid_placement"),
        number_of(c("valid_placement") & c("normalized_placement").isNull()).alias("placement_missing"), number_of(~c("normalized_placement").between(0, 1)).alias("placement_outside"),
        number_of(~c("walk_ratio").between(0, 1)).alias("walk_ratio_outside"), number_of(~c("assist_ratio").between(0, 1)).alias("assist_ratio_outside"),
        number_of(c("damage_per_kill").isNull()).alias("damage_per_kill_missing"), number_of(c("walk_ratio").isNull()).alias("walk_ratio_missing"),
    )


def orphans(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Rows whose match has no metadata."""
    return rows.join(metadata.select("match_id"), "match_id", "left_anti")


def reconstruct(raw: DataFrame, kept: DataFrame, split: DataFrame) -> DataFrame:
    """The cleaned table from the raw rows, the lineage of those kept, and the split."""
    return raw.join(kept.select("source_file", "source_row"), ["source_file", "source_row"]).join(split, "match_id")


def allowlist(task: str, columns: list[str]) -> list[str]:
    """The columns, if the task may use all of them; an outcome or a column outside the registry is an error."""
    wrong = [c for c in columns if c not in TASKS[task] or c in LEAKING[task]]
    if wrong:
        raise ValueError(f"not allowed for {task}: {', '.join(wrong)}")
    return columns


def feature_dictionary(spark) -> DataFrame:
    """(feature, definition, group, tasks) of every registered feature."""
    groups = {**dict.fromkeys(BASE, "base"), **dict.fromkeys(ABSOLUTE, "absolute"), **dict.fromkeys(PHASE, "phase")}
    rows = [(f, MEANING.get(f, f), g, ",".join(t for t, fs in TASKS.items() if f in fs)) for f, g in groups.items()]
    return spark.createDataFrame(rows, "feature string, definition string, feature_group string, tasks string")
