"""The library's operators as queries over the driver's tables, with SQL that gives the same rows.

The tables hold no match telemetry, so analog views stand in: `pm` (one row per player and match) over lineitem, `ev` (kill
events) over events. Floating-point results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skirmish.functions import stats as S
from skirmish.operators import clean as C
from skirmish.operators import clusters as K
from skirmish.operators import eda as E
from skirmish.operators import evaluate as V
from skirmish.operators import features as X
from skirmish.operators import models as M
from skirmish.operators import profiles as P
from skirmish.operators import timing as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PLACES = 6

PM_SQL = """
raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS match_id, CASE WHEN l_linenumber = 7 AND l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR) END AS player_name,
    CAST(l_linenumber % 3 AS VARCHAR) AS team_id, CAST(CASE WHEN l_orderkey % 4 = 0 THEN l_linenumber ELSE l_linenumber % 3 + 1 END AS DOUBLE) AS team_placement,
    CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS DOUBLE) AS party_size, CAST(round(l_discount * 100) AS DOUBLE) AS player_kills,
    CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_extendedprice END AS player_dmg, CAST(l_linenumber % 4 AS DOUBLE) AS player_assists, CAST(l_partkey % 3 AS DOUBLE) AS player_dbno,
    l_quantity AS player_dist_walk, CAST(round(l_tax * 100) AS DOUBLE) AS player_dist_ride, CAST(l_partkey % 1740 AS DOUBLE) + 60 * (l_linenumber % 2) AS player_survive_time,
    CAST(l_shipdate AS TIMESTAMP) AS date, CASE WHEN l_orderkey % 10 < 7 THEN 'train' WHEN l_orderkey % 10 < 9 THEN 'validation' ELSE 'test' END AS split,
    l_linestatus AS source_file, l_partkey * 8 + l_linenumber AS source_row
  FROM lineitem),
pm AS (
  SELECT *, CASE party_size WHEN 1 THEN 'Solo' WHEN 2 THEN 'Duo' WHEN 4 THEN 'Squad' ELSE 'Other' END AS team_size_mode FROM raw)
"""
META_SQL = """
teams AS (
  SELECT match_id, team_id, count(*) AS rows_, count(DISTINCT team_placement) AS placements FROM pm GROUP BY 1, 2),
meta AS (
  SELECT r.*, t.n_teams, t.conflicting_teams FROM (
    SELECT match_id, count(*) AS n_players, count(*) FILTER (WHERE team_id IS NULL) AS missing_team_rows, max(team_placement) AS max_placement,
      max(player_survive_time) FILTER (WHERE isfinite(player_survive_time) AND player_survive_time >= 0) AS duration_proxy, min(date) AS match_time,
      count(*) FILTER (WHERE date IS NULL) AS bad_dates, count(DISTINCT date) AS dates, count(DISTINCT party_size) AS party_values
    FROM pm GROUP BY 1) r
  JOIN (SELECT match_id, count(*) FILTER (WHERE team_id IS NOT NULL) AS n_teams, count(*) FILTER (WHERE team_id IS NOT NULL AND placements > 1) AS conflicting_teams FROM teams GROUP BY 1) t USING (match_id))
"""
BASE_SQL = """
flags AS (
  SELECT pm.*, n_teams, missing_team_rows, conflicting_teams, max_placement,
    coalesce(isfinite(player_survive_time) AND player_survive_time >= 0, false) AS valid_survival,
    coalesce(n_teams > 1 AND missing_team_rows = 0 AND conflicting_teams = 0 AND max_placement <= n_teams AND team_id IS NOT NULL AND team_placement BETWEEN 1 AND n_teams, false) AS valid_placement
  FROM pm JOIN meta USING (match_id)),
base AS (
  SELECT *, CASE WHEN valid_placement THEN 1 - (team_placement - 1) / (n_teams - 1) END AS normalized_placement,
    CASE WHEN player_kills > 0 THEN player_dmg / player_kills END AS damage_per_kill, player_dist_walk + player_dist_ride AS total_distance,
    CASE WHEN player_dist_walk + player_dist_ride > 0 THEN player_dist_walk / (player_dist_walk + player_dist_ride) END AS walk_ratio,
    CASE WHEN player_kills + player_assists > 0 THEN player_assists / (player_kills + player_assists) END AS assist_ratio,
    CASE WHEN player_survive_time > 0 THEN 60 * player_kills / player_survive_time END AS kills_per_minute,
    CASE WHEN player_survive_time > 0 THEN 60 * player_dmg / player_survive_time END AS damage_per_minute,
    CASE WHEN player_survive_time > 0 THEN player_dist_walk / player_survive_time END AS walk_velocity,
    CASE WHEN player_survive_time > 0 THEN player_dist_ride / player_survive_time END AS ride_velocity
  FROM flags)
"""
EV_SQL = """
ev AS (
  SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS match_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS killer_name,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(event_id * 7 % 150 AS VARCHAR) END AS victim_name,
    CAST(CASE WHEN event_id % 83 = 0 THEN -1 ELSE hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS DOUBLE) AS event_time, event_type AS raw_kind
  FROM events),
emeta AS (
  SELECT match_id, CASE WHEN substr(match_id, 9, 2) IN ('03', '17') THEN 30.0 ELSE 70000.0 END AS duration_proxy FROM (SELECT DISTINCT match_id FROM ev) WHERE substr(match_id, 9, 2) <> '05'),
epm AS (
  SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS match_id, CAST(user_id AS VARCHAR) AS player_name, CAST(count(*) FILTER (WHERE event_id % 3 > 0) AS DOUBLE) AS player_kills,
    CASE WHEN user_id % 4 = 0 THEN 'Solo' WHEN user_id % 4 = 1 THEN 'Duo' ELSE 'Squad' END AS team_size_mode
  FROM events GROUP BY 1, 2, user_id),
elig AS (
  SELECT e.*, duration_proxy FROM (SELECT DISTINCT * FROM ev) e JOIN emeta USING (match_id)
  WHERE killer_name IS NOT NULL AND coalesce(killer_name <> victim_name, true) AND isfinite(event_time) AND event_time >= 0),
rel AS (
  SELECT *, CASE WHEN isfinite(duration_proxy) AND duration_proxy >= 60 AND event_time <= duration_proxy THEN event_time / duration_proxy END AS rel FROM elig),
tm AS (
  SELECT match_id, killer_name, count(*) AS event_kills, min(event_time) AS first_kill_time, sum(event_time) / count(event_time) AS avg_kill_time, count(rel) AS phase_valid_events,
    count(*) FILTER (WHERE rel < CAST(1 AS DOUBLE) / 3) AS early_kills, count(*) FILTER (WHERE rel >= CAST(1 AS DOUBLE) / 3 AND rel < CAST(2 AS DOUBLE) / 3) AS mid_kills, count(*) FILTER (WHERE rel >= CAST(2 AS DOUBLE) / 3) AS late_kills
  FROM rel GROUP BY 1, 2),
joined AS (
  SELECT p.match_id, p.player_name, p.player_kills, p.team_size_mode, t.event_kills, t.first_kill_time, t.avg_kill_time,
    CASE WHEN player_kills > 0 THEN 1 WHEN player_kills = 0 THEN 0 END AS has_kill,
    CASE WHEN t.event_kills IS NULL AND player_kills = 0 THEN 'confirmed_no_kill' WHEN t.event_kills IS NULL THEN 'event_missing' WHEN NOT t.phase_valid_events > 0 THEN 'absolute_only' ELSE 'phase_observed' END AS timing_status,
    CASE WHEN t.event_kills IS NULL AND player_kills = 0 THEN 0 WHEN t.phase_valid_events > 0 THEN t.early_kills END AS early_kills,
    CASE WHEN t.event_kills IS NULL AND player_kills = 0 THEN 0 WHEN t.phase_valid_events > 0 THEN t.mid_kills END AS mid_kills,
    CASE WHEN t.event_kills IS NULL AND player_kills = 0 THEN 0 WHEN t.phase_valid_events > 0 THEN t.late_kills END AS late_kills,
    CASE WHEN t.phase_valid_events > 0 THEN CAST(t.early_kills AS DOUBLE) / t.phase_valid_events END AS early_kill_ratio,
    CASE WHEN t.phase_valid_events > 0 THEN CAST(t.mid_kills AS DOUBLE) / t.phase_valid_events END AS mid_kill_ratio,
    CASE WHEN t.phase_valid_events > 0 THEN CAST(t.late_kills AS DOUBLE) / t.phase_valid_events END AS late_kill_ratio
  FROM epm p LEFT JOIN tm t ON p.match_id = t.match_id AND p.player_name = t.killer_name)
"""
PRED_SQL = """
mean_train AS (SELECT avg(normalized_placement) AS v FROM base WHERE split = 'train'),
pred AS (
  SELECT match_id, team_id, team_size_mode, source_file, source_row, split, normalized_placement AS actual, CAST((SELECT v FROM mean_train) AS DOUBLE) AS predicted_a,
    0.5 + 0.01 * player_kills - 0.005 * (l % 7) AS predicted_b
  FROM (SELECT *, source_row AS l FROM base) WHERE valid_placement AND split = 'test')
"""
STAGES = {"pm": PM_SQL, "meta": META_SQL, "base": BASE_SQL, "ev": EV_SQL, "pred": PRED_SQL}
NEEDS = {"pm": ["pm"], "meta": ["pm", "meta"], "base": ["pm", "meta", "base"], "ev": ["ev"], "pred": ["pm", "meta", "base", "pred"], "": []}


def query(sql: str, over: str = "pm") -> Callable:
    """Register a query under its function's name, with SQL over the named views."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            head = ",".join(STAGES[v] for v in NEEDS[over])
            body = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH {head}" + (f", {body[5:]}" if body.startswith("WITH ") else f"\n{body}")) if head else body
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{c}`"), places) + 0.0).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    li = table(spark, sf_dir, "lineitem")
    n = c("l_linenumber")
    party = F.when(c("l_returnflag") == "A", 1).when(c("l_returnflag") == "N", 2).otherwise(4).cast("double")
    return li.select(
        c("l_orderkey").cast("string").alias("match_id"), F.when((n == 7) & (c("l_suppkey") % 5 == 0), None).otherwise(c("l_suppkey").cast("string")).alias("player_name"),
        (n % 3).cast("string").alias("team_id"), F.when(c("l_orderkey") % 4 == 0, n).otherwise(n % 3 + 1).cast("double").alias("team_placement"), party.alias("party_size"),
        F.round(c("l_discount") * 100).alias("player_kills"), F.when(c("l_partkey") % 17 == 0, None).otherwise(c("l_extendedprice")).alias("player_dmg"),
        (n % 4).cast("double").alias("player_assists"), (c("l_partkey") % 3).cast("double").alias("player_dbno"), c("l_quantity").alias("player_dist_walk"),
        F.round(c("l_tax") * 100).alias("player_dist_ride"), ((c("l_partkey") % 1740).cast("double") + 60 * (n % 2)).alias("player_survive_time"), c("l_shipdate").cast("timestamp_ntz").alias("date"),
        F.when(c("l_orderkey") % 10 < 7, "train").when(c("l_orderkey") % 10 < 9, "validation").otherwise("test").alias("split"),
        c("l_linestatus").alias("source_file"), (c("l_partkey") * 8 + n).alias("source_row"),
    ).withColumn("team_size_mode", C.mode_of(c("party_size")))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pm(spark, sf_dir)
    return X.base_features(rows, C.match_metadata(rows))


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd")
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(
        day.alias("match_id"), F.when(c("event_id") % 97 == 0, None).otherwise(c("user_id").cast("string")).alias("killer_name"),
        F.when(c("event_id") % 89 == 0, None).otherwise((c("event_id") * 7 % 150).cast("string")).alias("victim_name"),
        F.when(c("event_id") % 83 == 0, -1).otherwise(seconds).cast("double").alias("event_time"), c("event_type").alias("raw_kind"),
    )


def ev_metadata(events: DataFrame) -> DataFrame:
    day = F.substring("match_id", 9, 2)
    return events.select("match_id").distinct().where(day != "05").withColumn("duration_proxy", F.when(day.isin("03", "17"), 30.0).otherwise(70000.0))


def ev_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    mode = F.when(c("user_id") % 4 == 0, "Solo").when(c("user_id") % 4 == 1, "Duo").otherwise("Squad")
    each = table(spark, sf_dir, "events").groupBy(F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("match_id"), "user_id").agg(S.number_of(c("event_id") % 3 > 0).cast("double").alias("player_kills"))
    return each.select("match_id", c("user_id").cast("string").alias("player_name"), "player_kills", mode.alias("team_size_mode"))


def ev_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ev(spark, sf_dir)
    return G.with_timing(ev_players(spark, sf_dir), G.timing(events, ev_metadata(events)))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows with two predictions: the training mean, and a made-up one that differs from row to row."""
    b = base(spark, sf_dir)
    mean = M.baseline(b.where(F.col("split") == "train"), "normalized_placement", "mean")
    other = 0.5 + 0.01 * F.col("player_kills") - 0.005 * (F.col("source_row") % 7)
    return b.where(F.col("valid_placement") & (F.col("split") == "test")).select(
        "match_id", "team_id", "team_size_mode", "source_file", "source_row", "split", F.col("normalized_placement").alias("actual"), F.lit(mean).alias("predicted_a"), other.alias("predicted_b"))


def side(p: DataFrame, s: str) -> DataFrame:
    return p.withColumnRenamed(f"predicted_{s}", "predicted")


# Features and validity


@query("""
SELECT match_id, player_name, source_row, valid_survival, valid_placement, round(normalized_placement, 6) AS normalized_placement, round(damage_per_kill, 6) AS damage_per_kill, total_distance,
  round(walk_ratio, 6) AS walk_ratio, round(assist_ratio, 6) AS assist_ratio, round(kills_per_minute, 6) AS kills_per_minute, round(walk_velocity, 6) AS walk_velocity FROM base""", "base")
def base_features(spark, sf_dir):
    cols = ["match_id", "player_name", "source_row", "valid_survival", "valid_placement", "normalized_placement", "damage_per_kill", "total_distance", "walk_ratio", "assist_ratio", "kills_per_minute", "walk_velocity"]
    return rounded(base(spark, sf_dir).select(*cols))


@query("""
SELECT count(*) AS rows, count(*) FILTER (WHERE valid_survival) AS valid_survival, count(*) FILTER (WHERE valid_placement) AS valid_placement,
  count(*) FILTER (WHERE valid_placement AND normalized_placement IS NULL) AS placement_missing, count(*) FILTER (WHERE normalized_placement NOT BETWEEN 0 AND 1) AS placement_outside,
  count(*) FILTER (WHERE walk_ratio NOT BETWEEN 0 AND 1) AS walk_ratio_outside, count(*) FILTER (WHERE assist_ratio NOT BETWEEN 0 AND 1) AS assist_ratio_outside,
  count(*) FILTER (WHERE damage_per_kill IS NULL) AS damage_per_kill_missing, count(*) FILTER (WHERE walk_ratio IS NULL) AS walk_ratio_missing FROM base""", "base")
def feature_validation(spark, sf_dir):
    return X.feature_validation(base(spark, sf_dir))


@query("""
SELECT match_id, source_row, source_file, player_dmg, player_dist_walk FROM base ORDER BY player_dmg DESC NULLS LAST, match_id, source_file, source_row LIMIT 8""", "base")
def feature_topk(spark, sf_dir):
    b = base(spark, sf_dir)
    return b.orderBy(F.col("player_dmg").desc_nulls_last(), "match_id", "source_file", "source_row").limit(8).select("match_id", "source_row", "source_file", "player_dmg", "player_dist_walk")


@query("SELECT team_size_mode, party_size, count(*) AS n FROM pm GROUP BY ALL")
def mode_mapping(spark, sf_dir):
    return pm(spark, sf_dir).groupBy("team_size_mode", "party_size").agg(F.count(F.lit(1)).alias("n"))


# Cleaning


def dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pm(spark, sf_dir)
    again = rows.where(F.col("source_row") % 5 == 0).withColumn("source_row", F.col("source_row") + 1_000_000_000)
    return rows.unionByName(again)


DUPES = "SELECT * FROM pm UNION ALL SELECT * REPLACE (source_row + 1000000000 AS source_row) FROM pm WHERE source_row % 5 = 0"
KEYS = "match_id, player_name, team_id, team_placement, party_size, player_kills, player_dmg, player_assists, player_dbno, player_dist_walk, player_dist_ride, player_survive_time, date, split, team_size_mode"
NUMERIC = ["party_size", "player_kills", "player_dmg", "player_assists", "player_dbno", "player_dist_walk", "player_dist_ride", "player_survive_time", "team_placement"]


@query(f"""
WITH exact AS (SELECT {KEYS}, min(struct_pack(f := source_file, r := source_row)) AS lineage FROM ({DUPES}) GROUP BY ALL)
SELECT match_id, player_name, player_dmg, lineage.f AS source_file, lineage.r AS source_row FROM exact""")
def exact_dedup_lineage(spark, sf_dir):
    return C.exact_dedup(dupes(spark, sf_dir)).select("match_id", "player_name", "player_dmg", "source_file", "source_row")


@query("SELECT match_id, player_name, count(*) AS variants FROM pm WHERE match_id IS NOT NULL AND player_name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def identity_conflicts(spark, sf_dir):
    return C.identity_conflicts(pm(spark, sf_dir))


@query("""
SELECT match_id, player_name, source_row FROM pm ANTI JOIN (SELECT match_id, player_name FROM pm GROUP BY 1, 2 HAVING count(*) > 1) USING (match_id, player_name)""")
def conflict_quarantine(spark, sf_dir):
    return C.quarantine(pm(spark, sf_dir)).select("match_id", "player_name", "source_row")


@query(f"""
WITH exact AS (SELECT {KEYS}, min(struct_pack(f := source_file, r := source_row)) AS lineage FROM ({DUPES}) GROUP BY ALL),
single AS (SELECT * FROM exact ANTI JOIN (SELECT match_id, player_name FROM exact GROUP BY 1, 2 HAVING count(*) > 1) USING (match_id, player_name)),
sizes AS (SELECT 0 AS k, count(*) AS n FROM ({DUPES}) UNION ALL SELECT 1, count(*) FROM exact UNION ALL SELECT 2, count(*) FROM single
  UNION ALL SELECT 3, count(*) FROM single WHERE NOT coalesce(match_id IS NULL OR player_dist_ride < 0 OR player_kills < 0 OR player_dmg < 0, false))
SELECT CAST(a.k AS INTEGER) AS step_no, CASE a.k WHEN 1 THEN 'exact_duplicate' WHEN 2 THEN 'identity_conflict' ELSE 'invalid' END AS step, b.n AS rows_before, b.n - a.n AS removed, a.n AS rows_after
FROM sizes a JOIN sizes b ON a.k = b.k + 1""")
def removal_ledger(spark, sf_dir):
    return C.removal_ledger(dupes(spark, sf_dir), NUMERIC)


@query("""
SELECT match_id, source_row, sha256(CASE WHEN player_name IS NULL THEN to_json(struct_pack(m := match_id, p := player_name, f := source_file, r := source_row))
  ELSE to_json(struct_pack(m := match_id, p := player_name, f := CAST(NULL AS VARCHAR), r := CAST(NULL AS BIGINT))) END) AS row_id FROM pm""")
def row_id_hash(spark, sf_dir):
    return C.with_identity(pm(spark, sf_dir)).select("match_id", "source_row", "row_id")


@query("""
SELECT CAST(CAST('0x' || substr(sha256(match_id), 1, 16) AS UBIGINT) % 16 AS INTEGER) AS bucket, count(*) AS n FROM pm GROUP BY 1""")
def hash_bucket(spark, sf_dir):
    return pm(spark, sf_dir).groupBy(S.hash_bucket(F.col("match_id"), 16).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH raw_text AS (SELECT CASE o_orderkey % 9 WHEN 0 THEN ' 12 ' WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'abc' WHEN 4 THEN '1e3' WHEN 5 THEN 'inf' WHEN 6 THEN 'NaN' WHEN 7 THEN '2.5' ELSE NULL END AS t FROM orders),
num AS (SELECT t, nullif(trim(t), '') AS s, try_cast(nullif(trim(t), '') AS DOUBLE) AS v FROM raw_text)
SELECT count(*) AS rows, count(*) FILTER (WHERE s IS NULL) AS missing, count(*) FILTER (WHERE s IS NOT NULL AND (v IS NULL OR NOT isfinite(v))) AS parse_errors,
  count(*) FILTER (WHERE isfinite(v) AND v % 1 <> 0) AS non_integers, round(sum(v) FILTER (WHERE isfinite(v)), 6) AS total FROM num""", "")
def numeric_coercion(spark, sf_dir):
    from skirmish.sources.shards import quality

    k = F.col("o_orderkey") % 9
    texts = [" 12 ", "", "  ", "abc", "1e3", "inf", "NaN", "2.5"]
    t = reduce(lambda a, i: F.when(k == i, texts[i]).otherwise(a), range(8), F.lit(None).cast("string"))
    rows = table(spark, sf_dir, "orders").select(t.alias("t"))
    return rounded(rows.agg(F.count(F.lit(1)).alias("rows"), *quality("t"), F.sum(S.to_number(F.col("t"))).alias("total")))


@query("""
SELECT match_id, CAST(n_players AS BIGINT) AS n_players, CAST(n_teams AS BIGINT) AS n_teams, CAST(missing_team_rows AS BIGINT) AS missing_team_rows, CAST(conflicting_teams AS BIGINT) AS conflicting_teams,
  max_placement, duration_proxy, CAST(match_time AS TIMESTAMP) AS match_time, CAST(bad_dates AS BIGINT) AS bad_dates, CAST(dates AS BIGINT) AS dates, CAST(party_values AS BIGINT) AS party_values FROM meta""", "meta")
def match_metadata(spark, sf_dir):
    return C.match_metadata(pm(spark, sf_dir))


@query("""
SELECT match_id, count(DISTINCT team_id) AS n_teams, count(DISTINCT date) AS dates, count(DISTINCT party_size) AS party_values FROM pm GROUP BY 1""")
def match_metadata_distinct(spark, sf_dir):
    return pm(spark, sf_dir).groupBy("match_id").agg(F.count_distinct("team_id").alias("n_teams"), F.count_distinct("date").alias("dates"), F.count_distinct("party_size").alias("party_values"))


BLOCK_SPLIT = """
WITH blocks AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n FROM orders GROUP BY 1),
run AS (SELECT day, n, row_number() OVER (ORDER BY day) - 1 AS i, sum(n) OVER (ORDER BY day) AS c, sum(n) OVER () AS total, count(*) OVER () AS b FROM blocks),
cut1 AS (SELECT least(greatest(1, count(*) FILTER (WHERE c < total * 0.7) + 1), max(b) - 2) AS c1, count(*) FILTER (WHERE c < total * (0.7 + 0.15)) + 1 AS b2, max(b) AS b FROM run),
cuts AS (SELECT c1, least(greatest(c1 + 1, b2), b - 1) AS c2 FROM cut1),
named AS (SELECT day, n, CASE WHEN i < c1 THEN 'train' WHEN i < c2 THEN 'validation' ELSE 'test' END AS split FROM run, cuts)
"""


def order_blocks(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days, C.block_split(days, "day", "n", (0.7, 0.15, 0.15))


@query(BLOCK_SPLIT + "SELECT day, split FROM named", "")
def time_block_split(spark, sf_dir):
    return order_blocks(spark, sf_dir)[1]


@query(BLOCK_SPLIT + "SELECT split, CAST(sum(n) AS BIGINT) AS matches, count(*) AS blocks, min(day) AS first_day, max(day) AS last_day FROM named GROUP BY 1", "")
def split_summary(spark, sf_dir):
    days, split = order_blocks(spark, sf_dir)
    return days.join(split, "day").groupBy("split").agg(F.sum("n").alias("matches"), F.count(F.lit(1)).alias("blocks"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query("""
WITH b AS (SELECT match_id, CAST(CAST('0x' || substr(sha256(match_id), 1, 16) AS UBIGINT) % 10000 AS INTEGER) AS k FROM (SELECT DISTINCT match_id FROM pm))
SELECT CASE WHEN k < 7000 THEN 'train' WHEN k < 8500 THEN 'validation' ELSE 'test' END AS split, count(*) AS matches FROM b GROUP BY 1""")
def match_hash_split(spark, sf_dir):
    return pm(spark, sf_dir).select("match_id").distinct().groupBy(C.hash_split(F.col("match_id")).alias("split")).agg(F.count(F.lit(1)).alias("matches"))


@query("SELECT match_id, count(*) AS n FROM pm WHERE match_id NOT IN (SELECT match_id FROM meta WHERE n_players > 3) GROUP BY 1", "meta")
def orphan_antijoin(spark, sf_dir):
    p = pm(spark, sf_dir)
    return X.orphans(p, C.match_metadata(p).where("n_players > 3")).groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH kept AS (SELECT DISTINCT source_file, source_row FROM pm WHERE source_row % 3 = 0), sp AS (SELECT DISTINCT match_id, split AS assigned FROM pm WHERE match_id <> '1')
SELECT match_id, source_file, source_row, player_kills, assigned FROM pm JOIN kept USING (source_file, source_row) JOIN sp USING (match_id)""")
def reconstruct_join(spark, sf_dir):
    rows = pm(spark, sf_dir)
    kept = rows.where(F.col("source_row") % 3 == 0).select("source_file", "source_row").distinct()
    split = rows.where(F.col("match_id") != "1").select("match_id", F.col("split").alias("assigned")).distinct()
    return X.reconstruct(rows, kept, split).select("match_id", "source_file", "source_row", "player_kills", "assigned")


@query("""
SELECT count(*) AS n FROM pm WHERE player_name IS DISTINCT FROM team_id AND player_dmg IS DISTINCT FROM NULL""")
def null_safe_diff(spark, sf_dir):
    c = F.col
    return pm(spark, sf_dir).where(~c("player_name").eqNullSafe(c("team_id")) & ~c("player_dmg").eqNullSafe(F.lit(None))).agg(F.count(F.lit(1)).alias("n"))


# Timing


@query("""
SELECT match_id, killer_name, event_kills, first_kill_time, round(avg_kill_time, 6) AS avg_kill_time, phase_valid_events, early_kills, mid_kills, late_kills FROM tm""", "ev")
def timing_agg(spark, sf_dir):
    events = ev(spark, sf_dir)
    return rounded(G.timing(events, ev_metadata(events)))


@query("""
SELECT match_id, player_name, timing_status, CAST(early_kills AS DOUBLE) AS early_kills, CAST(mid_kills AS DOUBLE) AS mid_kills, CAST(late_kills AS DOUBLE) AS late_kills, round(early_kill_ratio, 6) AS early_kill_ratio, round(late_kill_ratio, 6) AS late_kill_ratio FROM joined""", "ev")
def timing_status(spark, sf_dir):
    kills = [F.col(f"{p}_kills").cast("double").alias(f"{p}_kills") for p in ("early", "mid", "late")]
    return rounded(ev_joined(spark, sf_dir).select("match_id", "player_name", "timing_status", *kills, "early_kill_ratio", "late_kill_ratio"))


@query("""
SELECT team_size_mode, timing_status, count(*) AS rows, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY team_size_mode) AS DOUBLE), 6) AS share FROM joined GROUP BY 1, 2""", "ev")
def timing_coverage(spark, sf_dir):
    return rounded(G.coverage(ev_joined(spark, sf_dir)))


@query("""
SELECT team_size_mode, count(*) AS rows, CAST(sum(early_kills) AS BIGINT) AS early_kills, CAST(sum(mid_kills) AS BIGINT) AS mid_kills, CAST(sum(late_kills) AS BIGINT) AS late_kills,
  round(avg(early_kill_ratio), 6) AS early_ratio, round(avg(mid_kill_ratio), 6) AS mid_ratio, round(avg(late_kill_ratio), 6) AS late_ratio FROM joined WHERE timing_status = 'phase_observed' GROUP BY 1""", "ev")
def timing_phase_summary(spark, sf_dir):
    return rounded(G.phase_summary(ev_joined(spark, sf_dir)))


@query("""
SELECT timing_status, count(*) AS rows, round(avg(abs(player_kills - coalesce(event_kills, 0))), 6) AS mean_abs_difference, count(*) FILTER (WHERE player_kills = coalesce(event_kills, 0)) AS agreeing
FROM joined GROUP BY 1""", "ev")
def kill_discrepancy(spark, sf_dir):
    return rounded(G.discrepancy_summary(ev_joined(spark, sf_dir)))


@query("""
SELECT count(*) AS events, count(*) FILTER (WHERE match_id IS NULL) AS no_match, count(*) FILTER (WHERE m.duration_proxy IS NULL) AS orphans, count(*) FILTER (WHERE killer_name IS NULL) AS no_killer,
  count(*) FILTER (WHERE victim_name IS NULL) AS no_victim, count(*) FILTER (WHERE killer_name = victim_name) AS self_kills, count(*) FILTER (WHERE event_time IS NULL OR NOT isfinite(event_time)) AS no_time,
  count(*) FILTER (WHERE event_time < 0) AS negative_time, count(*) FILTER (WHERE event_time > duration_proxy) AS after_end, count(*) FILTER (WHERE duration_proxy < 60) AS short_match
FROM ev LEFT JOIN emeta m USING (match_id)""", "ev")
def event_diagnostics(spark, sf_dir):
    events = ev(spark, sf_dir)
    return G.event_diagnostics(events, ev_metadata(events))


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""", "")
def event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    out = events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return rounded(out, 4)


# Distributions and relationships


STATS_COLUMNS = [*X.BASE, "player_survive_time", "normalized_placement"]


def unpivoted(columns: list[str], where: str = "split <> 'test'") -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS DOUBLE) AS x FROM base WHERE {where}" for c in columns)


@query(f"""
WITH long AS ({unpivoted(STATS_COLUMNS)})
SELECT "column", count(*) AS n, count(x) AS valid, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max,
  round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, round(skewness(x), 6) AS skewness, count(*) FILTER (WHERE x = 0) AS zeros, count(*) FILTER (WHERE x IS NULL) AS missing
FROM long GROUP BY 1""", "base")
def eda_stats(spark, sf_dir):
    return rounded(E.statistics(E.development(base(spark, sf_dir)), STATS_COLUMNS))


@query("""
SELECT round(quantile_cont(player_dmg, 0.1), 6) AS q10, round(quantile_cont(player_dmg, 0.5), 6) AS q50, round(quantile_cont(player_dmg, 0.9), 6) AS q90 FROM pm""")
def eda_quantiles(spark, sf_dir):
    return rounded(E.quantiles(pm(spark, sf_dir), "player_dmg", (0.1, 0.5, 0.9)))


@query("SELECT team_size_mode, round(skewness(player_dmg), 6) AS dmg, round(skewness(player_kills), 6) AS kills FROM pm GROUP BY 1")
def eda_skew(spark, sf_dir):
    return rounded(pm(spark, sf_dir).groupBy("team_size_mode").agg(S.skewness(F.col("player_dmg")).alias("dmg"), S.skewness(F.col("player_kills")).alias("kills")))


@query("""
WITH b AS (SELECT min(player_dist_walk) AS lo, (max(player_dist_walk) - min(player_dist_walk)) / 30 AS w FROM pm),
c AS (SELECT CAST(least(29, floor((player_dist_walk - lo) / w)) AS INTEGER) AS bin, count(*) AS n FROM pm, b WHERE player_dist_walk IS NOT NULL GROUP BY 1)
SELECT CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * w, 6) AS lower, coalesce(n, 0) AS n FROM (SELECT unnest(range(30)) AS bin) r LEFT JOIN c USING (bin), b""")
def eda_histogram30(spark, sf_dir):
    return rounded(E.histogram(pm(spark, sf_dir), "player_dist_walk"))


@query("""
SELECT team_size_mode, count(*) AS rows, round(avg(player_kills), 6) AS player_kills_mean, round(stddev_samp(player_kills), 6) AS player_kills_std, round(avg(damage_per_kill), 6) AS damage_per_kill_mean,
  round(stddev_samp(damage_per_kill), 6) AS damage_per_kill_std, round(avg(walk_ratio), 6) AS walk_ratio_mean, round(stddev_samp(walk_ratio), 6) AS walk_ratio_std FROM base GROUP BY 1""", "base")
def mode_statistics(spark, sf_dir):
    return rounded(E.mode_statistics(base(spark, sf_dir), ["player_kills", "damage_per_kill", "walk_ratio"]))


@query("SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT match_id) AS matches FROM pm GROUP BY 1")
def date_coverage(spark, sf_dir):
    return E.date_coverage(pm(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""
SELECT team_size_mode, count(*) AS n, round(corr(player_dmg, player_dist_walk), 6) AS pearson FROM pm WHERE isfinite(player_dmg) AND isfinite(player_dist_walk) GROUP BY 1""")
def pearson_by_mode(spark, sf_dir):
    c = F.col
    both = pm(spark, sf_dir).where(S.finite(c("player_dmg")) & S.finite(c("player_dist_walk")))
    return rounded(both.groupBy("team_size_mode").agg(F.count(F.lit(1)).alias("n"), S.pearson(c("player_dmg"), c("player_dist_walk")).alias("pearson")))


RANKED = """
WITH pairs AS (SELECT {g} AS g, player_dmg AS x, player_survive_time AS y FROM pm WHERE isfinite(player_dmg) AND isfinite(player_survive_time)),
ranked AS (SELECT g, x, y, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM pairs)
"""


@query(RANKED.format(g="1") + "SELECT count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM ranked")
def spearman_global(spark, sf_dir):
    return rounded(E.spearman(pm(spark, sf_dir), "player_dmg", "player_survive_time"))


@query(RANKED.format(g="team_size_mode").replace("FROM pm WHERE", "FROM base WHERE split <> 'test' AND valid_survival AND").replace("FROM base", "FROM base") + """
SELECT g AS team_size_mode, 'player_survive_time' AS target, 'player_dmg' AS feature, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, 'ok' AS status FROM ranked GROUP BY 1""", "base")
def spearman_by_mode(spark, sf_dir):
    out = E.correlations(base(spark, sf_dir), {"player_survive_time": "valid_survival"}, ["player_dmg"])
    return rounded(out.select("team_size_mode", "target", "feature", "n", "pearson", "spearman", "status"))


@query("""
SELECT DISTINCT player_dist_walk AS value, count(*) OVER (PARTITION BY player_dist_walk) AS n, CAST(rank() OVER (ORDER BY player_dist_walk) + (count(*) OVER (PARTITION BY player_dist_walk) - 1) / 2.0 AS DOUBLE) AS rank FROM pm""")
def average_rank(spark, sf_dir):
    return E.average_ranks(pm(spark, sf_dir), "player_dist_walk")


CORR_SQL = " UNION ALL ".join(
    f"SELECT team_size_mode, '{t}' AS target, '{f}' AS feature, count(*) AS n, round(corr({f}, {t}), 6) AS pearson FROM base WHERE split <> 'test' AND {v} AND isfinite({f}) AND isfinite({t}) GROUP BY 1"
    for t, v in (("player_survive_time", "valid_survival"), ("normalized_placement", "valid_placement")) for f in X.BASE)


@query(CORR_SQL, "base")
def relationship_pearson(spark, sf_dir):
    out = E.correlations(base(spark, sf_dir), {"player_survive_time": "valid_survival", "normalized_placement": "valid_placement"}, X.BASE, ranks=False)
    return rounded(out.select("team_size_mode", "target", "feature", "n", "pearson"))


RANK_FEATURES = X.BASE
RANK_SQL = " UNION ALL ".join(f"""
SELECT g AS team_size_mode, '{t}' AS target, '{f}' AS feature, count(*) AS n, round(CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END, 6) AS spearman FROM (
  SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry
  FROM (SELECT team_size_mode AS g, {f} AS x, {t} AS y FROM base WHERE split <> 'test' AND {v} AND isfinite({f}) AND isfinite({t}))) GROUP BY 1"""
    for t, v in (("player_survive_time", "valid_survival"), ("normalized_placement", "valid_placement")) for f in RANK_FEATURES)


@query(RANK_SQL, "base")
def relationship_spearman(spark, sf_dir):
    out = E.correlations(base(spark, sf_dir), {"player_survive_time": "valid_survival", "normalized_placement": "valid_placement"}, RANK_FEATURES)
    return rounded(out.select("team_size_mode", "target", "feature", "n", "spearman"))


def timed(b: DataFrame) -> DataFrame:
    """base with stand-ins for the timing features; TIMED_SQL is the same."""
    c = F.col
    return b.withColumns({
        "first_kill_time": F.when(c("player_kills") > 0, c("player_survive_time") / 2), "avg_kill_time": F.when(c("player_kills") > 0, c("player_survive_time") / 2 + c("player_dbno")),
        "has_kill": F.when(c("player_kills") > 0, 1).otherwise(0), "early_kills": c("player_dbno"), "mid_kills": c("player_assists"), "late_kills": c("player_kills") - c("player_dbno"),
        "early_kill_ratio": c("walk_ratio"), "mid_kill_ratio": c("assist_ratio"), "late_kill_ratio": F.when(c("player_kills") > 0, c("player_dbno") / c("player_kills")),
    })


TIMED_SQL = """
wide AS (SELECT *, CASE WHEN player_kills > 0 THEN player_survive_time / 2 END AS first_kill_time, CASE WHEN player_kills > 0 THEN player_survive_time / 2 + player_dbno END AS avg_kill_time,
  CASE WHEN player_kills > 0 THEN 1 ELSE 0 END AS has_kill, player_dbno AS early_kills, player_assists AS mid_kills, player_kills - player_dbno AS late_kills, walk_ratio AS early_kill_ratio,
  assist_ratio AS mid_kill_ratio, CASE WHEN player_kills > 0 THEN player_dbno / player_kills END AS late_kill_ratio FROM base)
"""
TABLE_SQL = f"""
WITH {TIMED_SQL}, modes AS (SELECT 'Overall' AS mode UNION SELECT team_size_mode FROM wide),
every AS (SELECT mode, w.* FROM (SELECT * FROM wide WHERE split <> 'test') w JOIN modes ON mode IN ('Overall', team_size_mode)),
long AS ({" UNION ALL ".join(f"SELECT mode, '{t}' AS target, '{f}' AS feature, CAST({f} AS DOUBLE) AS x, {t} AS y FROM every WHERE {v} AND isfinite(CAST({f} AS DOUBLE)) AND isfinite({t})" for t, v in (("player_survive_time", "valid_survival"), ("normalized_placement", "valid_placement")) for f in X.TASKS["p2"])}),
ranked AS (SELECT *, rank() OVER (PARTITION BY mode, target, feature ORDER BY x) + (count(*) OVER (PARTITION BY mode, target, feature, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY mode, target, feature ORDER BY y) + (count(*) OVER (PARTITION BY mode, target, feature, y) - 1) / 2.0 AS ry FROM long),
found AS (SELECT mode, target, feature, count(*) AS n, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(rx, ry) END AS spearman FROM ranked GROUP BY 1, 2, 3),
pairs AS (SELECT mode, target, feature FROM modes, (SELECT unnest(['player_survive_time', 'normalized_placement']) AS target), (SELECT unnest({X.TASKS["p2"]}) AS feature))
SELECT mode, target, feature, coalesce(n, 0) AS n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, CASE WHEN n >= 3 AND spearman IS NOT NULL THEN 'ok' ELSE 'undefined' END AS status,
  'train+validation' AS analysis_scope, NOT (target = 'player_survive_time' AND feature IN ({", ".join(f"'{f}'" for f in X.PHASE)})) AS "primary", 'pending' AS time_unit_status, 'dimensionless' AS coefficient_unit
FROM pairs LEFT JOIN found USING (mode, target, feature)
"""


@query(TABLE_SQL, "base")
def relationship_table(spark, sf_dir):
    wide = timed(base(spark, sf_dir))
    return rounded(E.relationships(wide, {"player_survive_time": "valid_survival", "normalized_placement": "valid_placement"}, X.TASKS["p2"], X.PHASE))


DESCRIBED = ["player_kills", "player_dmg"]


@query("WITH long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS x FROM pm" for c in DESCRIBED) + """)
SELECT "column", count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50,
  round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM long GROUP BY 1""")
def describe_summary(spark, sf_dir):
    return rounded(E.describe(pm(spark, sf_dir), DESCRIBED))


@query("WITH long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM pm WHERE {c} IS NOT NULL" for c in ("team_size_mode", "player_name", "split")) + """), c AS (SELECT "column", v, count(*) AS n FROM long GROUP BY 1, 2)
SELECT "column", CAST(sum(n) AS BIGINT) AS count, count(*) AS "unique", first(v ORDER BY n DESC, v) AS top, max(n) AS freq FROM c GROUP BY 1""")
def describe_text(spark, sf_dir):
    return E.describe_text(pm(spark, sf_dir), ["team_size_mode", "player_name", "split"])


# Profiles


PROFILE_SQL = """
WITH wide AS (SELECT *, CASE WHEN player_kills = 0 THEN 'confirmed_no_kill' WHEN source_row % 5 = 0 THEN 'event_missing' WHEN source_row % 5 = 1 THEN 'absolute_only' ELSE 'phase_observed' END AS timing_status,
  player_dbno AS early_kills, walk_ratio AS early_kill_ratio FROM base WHERE player_name IS NOT NULL),
prof AS (
  SELECT player_name, team_size_mode, count(*) AS games, count(*) FILTER (WHERE timing_status = 'phase_observed' AND player_kills > 0) AS phase_matches, avg(player_kills) AS mean_player_kills, avg(player_dmg) AS mean_player_dmg, avg(walk_ratio) AS mean_walk_ratio,
    stddev_samp(player_kills) AS std_kills, avg(early_kill_ratio) FILTER (WHERE timing_status = 'phase_observed' AND player_kills > 0) AS mean_early_kill_ratio, avg(CAST(player_kills > 0 AS INTEGER)) AS kill_active, avg(CASE timing_status WHEN 'confirmed_no_kill' THEN 0 WHEN 'phase_observed' THEN CAST(early_kills > 0 AS INTEGER) END) AS early_combat_match_ratio,
    avg(player_survive_time) FILTER (WHERE valid_survival) AS mean_survival, avg(normalized_placement) AS mean_placement
  FROM wide WHERE split <> 'test' GROUP BY 1, 2)
"""
PROFILE_COLUMNS = ["player_name", "team_size_mode", "games", "phase_matches", "mean_player_kills", "mean_player_dmg", "mean_walk_ratio", "std_kills", "mean_early_kill_ratio", "kill_active", "early_combat_match_ratio", "mean_survival", "mean_placement"]


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir)
    ratio = {f"{p}_kill_ratio": F.col("walk_ratio") for p in ("early", "mid", "late")}
    fifth = F.col("source_row") % 5
    status = F.when(F.col("player_kills") == 0, "confirmed_no_kill").when(fifth == 0, "event_missing").when(fifth == 1, "absolute_only").otherwise("phase_observed")
    return b.withColumns({"timing_status": status, "early_kills": F.col("player_dbno"), **ratio})


@query(PROFILE_SQL + "SELECT " + ", ".join(c if c in PROFILE_COLUMNS[:4] else f"round({c}, {3 if 'dmg' in c else 6}) AS {c}" for c in PROFILE_COLUMNS) + " FROM prof", "base")
def player_profiles(spark, sf_dir):
    return rounded(P.profiles(profile_rows(spark, sf_dir)).withColumn("mean_player_dmg", F.round("mean_player_dmg", 3)).select(*PROFILE_COLUMNS))


@query(PROFILE_SQL + """
SELECT team_size_mode, CAST(t AS INTEGER) AS threshold, count(*) AS total, count(*) FILTER (WHERE games >= t) AS retained, round(avg(CAST(games >= t AS INTEGER)), 6) AS coverage,
  round(quantile_cont(CAST(games AS DOUBLE), 0.5) FILTER (WHERE games >= t), 6) AS median_games, round(avg(phase_matches) FILTER (WHERE games >= t), 6) AS mean_phase_matches
FROM prof, (SELECT unnest([5, 10, 20, 50]) AS t) GROUP BY 1, 2""", "base")
def profile_retention(spark, sf_dir):
    return rounded(P.retention(P.profiles(profile_rows(spark, sf_dir))))


@query(PROFILE_SQL + """
SELECT team_size_mode, count(*) AS profiles, round(avg(CAST(mean_player_dmg IS NOT NULL AS INTEGER)), 6) AS mean_player_dmg, round(avg(CAST(std_kills IS NOT NULL AS INTEGER)), 6) AS std_kills,
  round(avg(CAST(mean_early_kill_ratio IS NOT NULL AS INTEGER)), 6) AS mean_early_kill_ratio FROM prof GROUP BY 1""", "base")
def profile_coverage(spark, sf_dir):
    return rounded(P.feature_coverage(P.profiles(profile_rows(spark, sf_dir)), ["mean_player_dmg", "std_kills", "mean_early_kill_ratio"]))


# Models


INPUTS = ["player_dmg", "damage_per_kill", "player_dist_walk"]
IMPUTED = "WITH m AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in INPUTS) + " FROM base WHERE split = 'train'), imp AS (SELECT match_id, source_row, split, " + ", ".join(
    f"coalesce({c}, (SELECT {c} FROM m)) AS {c}, CAST({c} IS NULL AS INTEGER) AS i_{c}" for c in INPUTS) + " FROM base)"


@query(IMPUTED + "SELECT split, count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in INPUTS) + ", round(avg(i_player_dmg), 6) AS missingindicator_player_dmg, round(avg(i_damage_per_kill), 6) AS missingindicator_damage_per_kill FROM imp GROUP BY 1", "base")
def impute_indicator(spark, sf_dir):
    b = base(spark, sf_dir)
    inputs = M.fit_inputs(b.where(F.col("split") == "train"), INPUTS)
    return rounded(b.select("split", *inputs.imputed()).groupBy("split").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in inputs.names)))


@query(IMPUTED + ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in INPUTS) + " FROM imp WHERE split = 'train') SELECT match_id, source_row, " + ", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) + CAST(0 AS DOUBLE) AS {c}" for c in INPUTS) + " FROM imp, s", "base")
def standardize(spark, sf_dir):
    b = base(spark, sf_dir)
    inputs = M.fit_inputs(b.where(F.col("split") == "train"), INPUTS)
    return rounded(b.select("match_id", "source_row", *inputs.scaled()).select("match_id", "source_row", *INPUTS))


METRIC_SQL = """count(*) AS n, round(sum(w * abs(actual - {p})) / sum(w), 6) AS mae, round(sqrt(sum(w * (actual - {p}) * (actual - {p})) / sum(w)), 6) AS rmse,
  round(CASE WHEN count(*) > 1 AND min(actual) < max(actual) THEN 1 - sum(w * (actual - {p}) * (actual - {p})) / sum(w * (actual - mu) * (actual - mu)) END, 6) AS r2"""


def metric_sql(rows: str, p: str, weight: str = "1.0", group: str = "") -> str:
    over = f"OVER (PARTITION BY {group})" if group else "OVER ()"
    cols = f"{group}, " if group else ""
    return f"SELECT {cols}{METRIC_SQL.format(p=p)} FROM (SELECT *, sum(w * actual) {over} / sum(w) {over} AS mu FROM (SELECT *, {weight} AS w FROM {rows})){' GROUP BY ' + group if group else ''}"


@query(metric_sql("pred", "predicted_a"), "pred")
def baseline_mean_metrics(spark, sf_dir):
    return rounded(V.micro(side(predicted(spark, sf_dir), "a")))


MEDIAN = "(SELECT *, (SELECT quantile_cont(normalized_placement, 0.5) FROM base WHERE split = 'train') AS med FROM pred)"


@query(metric_sql(MEDIAN, "med"), "pred")
def baseline_median_metrics(spark, sf_dir):
    median = M.baseline(base(spark, sf_dir).where(F.col("split") == "train"), "normalized_placement", "median")
    return rounded(V.micro(predicted(spark, sf_dir).withColumn("predicted", F.lit(median))))


@query(metric_sql("pred", "predicted_b"), "pred")
def metrics_micro(spark, sf_dir):
    return rounded(V.micro(side(predicted(spark, sf_dir), "b")))


@query(metric_sql("pred", "predicted_b", "1.0 / count(*) OVER (PARTITION BY match_id)"), "pred")
def metrics_match_aware(spark, sf_dir):
    return rounded(V.match_aware(side(predicted(spark, sf_dir), "b")))


TEAM = "(SELECT match_id, team_id, min(actual) AS actual, avg(predicted_b) AS predicted_b FROM pred WHERE team_id IS NOT NULL GROUP BY 1, 2)"


@query(metric_sql(TEAM, "predicted_b"), "pred")
def metrics_team_aware(spark, sf_dir):
    return rounded(V.team_aware(side(predicted(spark, sf_dir), "b")))


MATCH_WEIGHT = "1.0 / count(*) OVER (PARTITION BY match_id)"


@query(" UNION ALL ".join(f"SELECT '{k}' AS aggregation, * FROM ({q})" for k, q in (
    ("micro", metric_sql("pred", "predicted_b")), ("match_aware", metric_sql("pred", "predicted_b", MATCH_WEIGHT)), ("team_aware", metric_sql(TEAM, "predicted_b")))), "pred")
def hierarchical_metrics(spark, sf_dir):
    return rounded(V.hierarchical(side(predicted(spark, sf_dir), "b")))


def side_sql(s: str) -> list[str]:
    p, team = f"predicted_{s}", TEAM.replace("predicted_b", f"predicted_{s}")
    return [f"{k}_{s} AS ({q})" for k, q in (("micro", metric_sql("pred", p)), ("match_aware", metric_sql("pred", p, MATCH_WEIGHT)), ("team_aware", metric_sql(team, p)))]


@query("WITH " + ", ".join(side_sql("a") + side_sql("b")) + " " + " UNION ALL ".join(
    f"SELECT '{k}' AS aggregation, '{m}' AS metric, a.{m} AS reference, b.{m} AS candidate, round(b.{m} - a.{m}, 4) AS delta FROM {k}_a a, {k}_b b" for k in ("micro", "match_aware", "team_aware") for m in V.METRICS), "pred")
def paired_deltas(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("row_id", F.concat_ws("/", "match_id", "source_file", "source_row"))
    d = V.deltas(V.paired(*(side(p.drop(f"predicted_{o}"), s) for s, o in ("ab", "ba"))))
    return d.select("aggregation", "metric", F.round("reference", 6).alias("reference"), F.round("candidate", 6).alias("candidate"), F.round("delta", 4).alias("delta"))


@query(metric_sql("pred", "predicted_b", group="team_size_mode"), "pred")
def error_by_mode(spark, sf_dir):
    return rounded(V.metrics(side(predicted(spark, sf_dir), "b"), by=["team_size_mode"]))


REGION = "(SELECT *, CASE WHEN actual <= 0.3 THEN 0 WHEN actual <= 0.7 THEN 1 ELSE 2 END AS target_region FROM pred)"


@query(metric_sql(REGION, "predicted_b", group="target_region"), "pred")
def error_by_target_region(spark, sf_dir):
    p = side(predicted(spark, sf_dir), "b").withColumn("target_region", V.region([0.0, 0.3, 0.7, 1.0]))
    return rounded(V.metrics(p, by=["target_region"]))


@query("""
WITH r AS (SELECT actual - predicted_b AS e FROM pred), b AS (SELECT min(e) AS lo, max(e) AS hi FROM r), k AS (SELECT unnest(range(20)) AS i),
edges AS (SELECT i, lo + (hi - lo) * i / 20 AS lower, CASE WHEN i = 19 THEN hi ELSE lo + (hi - lo) * (i + 1) / 20 END AS upper FROM k, b)
SELECT CAST(i AS INTEGER) AS bin, round(CASE WHEN i = 0 THEN lower - 0.001 * (SELECT hi - lo FROM b) ELSE lower END, 6) AS lower, round(upper, 6) AS upper, count(e) AS n
FROM edges LEFT JOIN r ON (e > lower OR i = 0) AND (e <= upper OR i = 19) GROUP BY ALL""", "pred")
def residual_histogram20(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("residual", F.col("actual") - F.col("predicted_b"))
    return rounded(V.residual_histogram(p))


@query("""
WITH c AS (SELECT *, actual - (SELECT min(actual) FROM pred) AS y FROM pred)
SELECT match_id, count(*) AS n, round(sum(y), 6) AS total, round(sum(y * y), 6) AS squares, round(sum(abs(actual - predicted_b) - abs(actual - predicted_a)), 6) + CAST(0 AS DOUBLE) AS gained,
  round(sum((actual - predicted_a) * (actual - predicted_a)), 6) AS reference, round(sum((actual - predicted_b) * (actual - predicted_b)), 6) AS candidate FROM c GROUP BY 1""", "pred")
def bootstrap_state(spark, sf_dir):
    return rounded(V.bootstrap_state(predicted(spark, sf_dir))).withColumn("gained", F.col("gained") + F.lit(0.0))


@query("", "pred")
def bootstrap_intervals(spark, sf_dir):
    return V.bootstrap(predicted(spark, sf_dir))


@query("""
SELECT round(regr_slope(player_dmg, player_dist_walk), 4) AS slope, round(regr_intercept(player_dmg, player_dist_walk), 4) AS intercept FROM pm WHERE player_dmg IS NOT NULL""")
def ols_univariate(spark, sf_dir):
    x = pm(spark, sf_dir).where("player_dmg IS NOT NULL").select("player_dist_walk", "player_dmg")
    b, intercept, _, _ = M.least_squares(x, 1)
    return spark.createDataFrame([(round(float(b[0]), 4), round(intercept, 4))], "slope double, intercept double")


@query("")
def ols_tsqr(spark, sf_dir):
    b = base(spark, sf_dir).where(F.col("valid_placement") & (F.col("split") == "train"))
    return rounded(M.fit_linear(b, X.TASKS["t0"], "normalized_placement").table(spark))


@query("""
WITH p AS (SELECT label AS cluster, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT cluster, CAST(i AS INTEGER) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS center FROM p GROUP BY 1, 2""", "")
def cluster_centers(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("z"))
    return rounded(K.centers(rows).select("cluster", F.posexplode("center").alias("i", "center")))


@query("""
WITH p AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM p GROUP BY 1, 2),
d AS (SELECT p.label, vec_id, sqrt(sum((x - m) * (x - m))) AS d FROM p JOIN c USING (label, i) GROUP BY 1, 2), s AS (SELECT label, avg(d) AS s FROM d GROUP BY 1),
q AS (SELECT a.label AS u, b.label AS v, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
w AS (SELECT u, max((x.s + y.s) / dist) AS worst FROM q JOIN s x ON x.label = u JOIN s y ON y.label = v GROUP BY 1)
SELECT round(avg(worst), 6) AS davies_bouldin FROM w""", "")
def davies_bouldin(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("z"))
    return spark.createDataFrame([(round(K.davies_bouldin(rows), 6),)], "davies_bouldin double")


@query("""
WITH t AS (SELECT label AS a, CAST(vec_id % 7 AS INTEGER) AS b, count(*) AS n FROM embeddings GROUP BY 1, 2), c AS (SELECT sum(n * (n - 1) / 2) AS both_ FROM t),
ra AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY a)), rb AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT sum(n) AS n FROM t GROUP BY b)), n AS (SELECT sum(n) * (sum(n) - 1) / 2 AS v FROM t)
SELECT round((both_ - ra.v * rb.v / n.v) / ((ra.v + rb.v) / 2 - ra.v * rb.v / n.v), 6) AS ari FROM c, ra, rb, n""", "")
def ari(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("a"), (F.col("vec_id") % 7).alias("b"))
    return spark.createDataFrame([(round(K.adjusted_rand(rows, "a", "b"), 6),)], "ari double")


@query("", "")
def kmeans_centers(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("embedding").cast("array<double>").alias("z"))
    return K.centers(K.labelled(rows, K.k_means(rows, 4, 42))).select("cluster", "n", "center")
