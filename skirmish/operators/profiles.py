"""Player profiles by mode, and how many remain above a number of games."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skirmish.functions.stats import average_where, number_of, quantile
from skirmish.operators.eda import DEVELOPMENT

MEANS = ["player_kills", "player_dmg", "player_assists", "player_dbno", "player_dist_walk", "player_dist_ride", "walk_ratio", "assist_ratio"]
RATIOS = ["early_kill_ratio", "mid_kill_ratio", "late_kill_ratio"]
# What clustering looks at.
PROFILE_FEATURES = [*(f"mean_{c}" for c in MEANS), "std_kills", "std_dmg", *(f"mean_{c}" for c in RATIOS), "early_combat_match_ratio"]
THRESHOLDS = (5, 10, 20, 50)


def profiles(rows: DataFrame, development_only: bool = True, modes: tuple[str, ...] = ("Solo", "Duo", "Squad")) -> DataFrame:
    """One row per (player, mode): counts, mean behaviour, phase ratios over matches with observed kills, and outcomes.

    Outcomes are of development rows in every scope, so that test rows never show in them.
    """
    c = F.col
    dev = c("split").isin(*DEVELOPMENT)
    named = rows.where(c("player_name").isNotNull() & c("team_size_mode").isin(*modes))
    scope = named.where(dev) if development_only else named
    observed = c("timing_status") == "phase_observed"
    fought = observed & (c("player_kills") > 0)
    early = F.when(c("timing_status") == "confirmed_no_kill", 0.0).when(observed, (c("early_kills") > 0).cast("double"))
    return scope.groupBy("player_name", "team_size_mode").agg(
        F.count(F.lit(1)).alias("games"), number_of(dev).alias("development_games"), number_of(fought).alias("phase_matches"), *(F.avg(x).alias(f"mean_{x}") for x in MEANS),
        F.stddev_samp("player_kills").alias("std_kills"), F.stddev_samp("player_dmg").alias("std_dmg"), *(average_where(fought, c(x)).alias(f"mean_{x}") for x in RATIOS),
        F.avg((c("player_kills") > 0).cast("double")).alias("kill_active"), F.avg((c("player_assists") > 0).cast("double")).alias("support_active"), F.avg(early).alias("early_combat_match_ratio"),
        average_where(dev & c("valid_survival"), c("player_survive_time")).alias("mean_survival"), average_where(dev, c("normalized_placement")).alias("mean_placement"),
    )


def retention(profiled: DataFrame, thresholds: tuple[int, ...] = THRESHOLDS) -> DataFrame:
    """By mode and least number of games: profiles, those retained, their share, median games and mean phase matches."""
    each = profiled.select("team_size_mode", "games", "phase_matches", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    kept = F.col("games") >= F.col("threshold")
    return each.groupBy("team_size_mode", "threshold").agg(
        F.count(F.lit(1)).alias("total"), number_of(kept).alias("retained"), F.avg(kept.cast("double")).alias("coverage"),
        quantile(F.when(kept, F.col("games").cast("double")), 0.5).alias("median_games"), average_where(kept, F.col("phase_matches")).alias("mean_phase_matches"),
    )


def feature_coverage(profiled: DataFrame, features: list[str] | None = None) -> DataFrame:
    """By mode, the share of profiles with each feature."""
    return profiled.groupBy("team_size_mode").agg(F.count(F.lit(1)).alias("profiles"), *(F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in features or PROFILE_FEATURES))
