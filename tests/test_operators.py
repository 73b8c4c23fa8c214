import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skirmish.functions import stats as S
from skirmish.operators import clean as C
from skirmish.operators import clusters as K
from skirmish.operators import eda as E
from skirmish.operators import evaluate as V
from skirmish.operators import features as X
from skirmish.operators import models as M
from skirmish.operators import timing as G
from skirmish.sources import shards


def test_numbers_from_text(spark):
    texts = [("12",), (" 1e3 ",), ("1d",), ("2f",), ("inf",), ("NaN",), ("",), (None,), ("x",), ("2.5",)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(S.to_number(F.col("t"))).collect()] == [12, 1000, None, None, None, None, None, None, None, 2.5]
    assert df.agg(*shards.quality("t")).first().asDict() == {"missing": 2, "parse_errors": 5, "non_integers": 1}


def test_small_and_constant_samples(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 1.0), ("b", 2.0, 1.0), ("c", 1.0, 1.0), ("c", 2.0, 3.0), ("c", 9.0, 2.0)], "g string, x double, y double")
    got = {r["g"]: r for r in df.groupBy("g").agg(S.skewness(F.col("x")).alias("s"), S.pearson(F.col("x"), F.col("y")).alias("r")).collect()}
    assert got["a"]["s"] is None and got["b"]["s"] is None and got["a"]["r"] is None and got["b"]["r"] is None
    x = np.array([1.0, 2, 9])
    g1 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert got["c"]["s"] == pytest.approx(g1 * math.sqrt(6) / 1) and got["c"]["r"] == pytest.approx(np.corrcoef(x, [1, 3, 2])[0, 1])


def test_quantiles_and_ranks(spark):
    df = spark.range(0, 1200).select((F.col("id") * 7 % 1200).cast("double").alias("x"), (-(F.col("id") * 7 % 1200)).cast("double").alias("y"))
    q = E.quantiles(df, "x").first()
    assert (q["q50"], q["q25"], q["q75"]) == (599.5, 299.75, 899.25)
    r = E.spearman(df, "x", "y").first()
    assert (r["n"], round(r["pearson"], 9), round(r["spearman"], 9)) == (1200, -1, -1)
    tied = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (5.0,)], "x double")
    assert sorted((r["value"], r["n"], r["rank"]) for r in E.average_ranks(tied, "x").collect()) == [(1, 1, 1), (2, 2, 2.5), (5, 1, 4)]


def test_correlations_ignore_test_rows(spark):
    rows = [(i, float(i), float(i * i), "train", "Solo", True) for i in range(5)] + [(9, 1e9, -1e9, "test", "Solo", True), (8, None, 1.0, "train", "Solo", True), (7, 3.0, 1.0, "train", "Duo", False)]
    df = spark.createDataFrame(rows, "id long, f double, t double, split string, team_size_mode string, ok boolean")
    r = E.correlations(df, {"t": "ok"}, ["f"]).collect()
    assert len(r) == 1 and (r[0]["n"], round(r[0]["spearman"], 12), r[0]["status"]) == (5, 1.0, "ok")


def test_phase_boundaries_and_ineligible_events(spark):
    times = [0.0, 100.0, 100.0, 200.0, 300.0, 999.0, -1.0, float("inf"), None]
    rows = [("m", "a", f"v{i}", t, "r") for i, t in enumerate(times)]
    rows += [("m", "a", "v0", 0.0, "r"), ("m", "a", "a", 5.0, "r"), ("m", None, "b", 5.0, "r"), ("orphan", "a", "b", 1.0, "r"), (None, "a", "b", 1.0, "r"), ("short", "a", None, 1.0, "r"), ("undated", "a", "b", 1.0, "r")]
    events = spark.createDataFrame(rows, "match_id string, killer_name string, victim_name string, event_time double, raw_kind string")
    meta = spark.createDataFrame([("m", 300.0), ("short", 59.0), ("undated", None)], "match_id string, duration_proxy double")
    got = {r["match_id"]: r for r in G.timing(events, meta).collect()}
    m = got["m"]
    assert (m["event_kills"], m["phase_valid_events"], m["early_kills"], m["mid_kills"], m["late_kills"], m["first_kill_time"]) == (6, 5, 1, 2, 2, 0)
    assert m["avg_kill_time"] == pytest.approx(1699 / 6)
    assert got["short"]["phase_valid_events"] == got["undated"]["phase_valid_events"] == 0 and set(got) == {"m", "short", "undated"}
    base = spark.createDataFrame([("m", "a", 6.0), ("m", "b", 0.0), ("m", "c", None), ("m", "d", 2.0), ("short", "a", 1.0)], "match_id string, player_name string, player_kills double")
    status = {(r["match_id"], r["player_name"]): r for r in G.with_timing(base, G.timing(events, meta)).collect()}
    assert [status[k]["timing_status"] for k in (("m", "a"), ("m", "b"), ("m", "c"), ("m", "d"), ("short", "a"))] == ["phase_observed", "confirmed_no_kill", "event_missing", "event_missing", "absolute_only"]
    assert status["m", "b"]["early_kills"] == 0 and status["m", "d"]["early_kills"] is None and status["short", "a"]["early_kill_ratio"] is None


def test_events_that_differ_in_raw_columns_are_two(spark):
    e = spark.createDataFrame([("m", "a", "b", 1.0, "rifle"), ("m", "a", "b", 1.0, "pan"), ("m", "a", "b", 1.0, "pan")], "match_id string, killer_name string, victim_name string, event_time double, raw_kind string")
    meta = spark.createDataFrame([("m", 300.0)], "match_id string, duration_proxy double")
    assert G.timing(e, meta).first()["event_kills"] == 2


def test_quarantine_keeps_rows_with_null_keys(spark):
    rows = [("m", "a", 1), ("m", "a", 2), ("m", None, 3), ("m", None, 4), (None, "b", 5), ("n", "a", 6)]
    df = spark.createDataFrame(rows, "match_id string, player_name string, x int")
    assert sorted(r["x"] for r in C.quarantine(df).collect()) == [3, 4, 5, 6]
    assert C.identity_conflicts(df).collect()[0]["variants"] == 2


def test_invalid_rows_and_null_numbers(spark):
    df = spark.createDataFrame([("m", 1.0, -1.0), ("m", -1.0, 1.0), ("m", None, 1.0), (None, 1.0, 1.0), ("m", float("inf"), 1.0)], "match_id string, player_dmg double, player_survive_time double")
    kept = df.where(~C.invalid(df, ["player_dmg", "player_survive_time"])).collect()
    assert [(r[1], r[2]) for r in kept] == [(1.0, -1.0), (None, 1.0)]


def test_exact_dedup_keeps_least_lineage(spark):
    df = spark.createDataFrame([("m", None, "b", 0), ("m", None, "a", 9), ("m", None, "a", 3), ("n", 1, "c", 1)], "match_id string, v int, source_file string, source_row long")
    assert sorted(map(tuple, C.exact_dedup(df).collect()), key=str) == [("m", None, "a", 3), ("n", 1, "c", 1)]


def test_metadata_and_placement(spark):
    schema = "match_id string, player_name string, team_id string, team_placement double, player_survive_time double, date string, party_size double, player_kills double, player_dmg double, player_assists double, player_dist_walk double, player_dist_ride double"
    rows = [("a", "p", "x", 1.0, 100.0, "2026-01-01", 1.0), ("a", "q", "y", 2.0, float("nan"), "2026-01-01", 1.0), ("a", "r", "y", 2.0, -5.0, "bad", 2.0), ("b", "s", None, None, None, None, None), ("c", "t", "x", 1.0, 5.0, "2026-01-02", 1.0), ("c", "u", "x", 2.0, 7.0, "2026-01-02", 1.0)]
    df = spark.createDataFrame([(*r, 2.0, 50.0, 0.0, 0.0, 0.0) for r in rows], schema)
    meta = {r["match_id"]: r for r in C.match_metadata(df).collect()}
    assert (meta["a"]["n_teams"], meta["a"]["conflicting_teams"], meta["a"]["duration_proxy"], meta["a"]["bad_dates"], meta["a"]["dates"], meta["a"]["party_values"]) == (2, 0, 100, 1, 2, 2)
    assert (meta["b"]["n_teams"], meta["b"]["missing_team_rows"], meta["b"]["duration_proxy"], meta["b"]["dates"]) == (0, 1, None, 0)
    assert (meta["c"]["conflicting_teams"], meta["c"]["duration_proxy"]) == (1, 7)
    out = {r["player_name"]: r for r in X.base_features(df, C.match_metadata(df)).collect()}
    assert [out[p]["normalized_placement"] for p in "pqstu"] == [1.0, 0.0, None, None, None]
    assert [out[p]["valid_survival"] for p in "pqrs"] == [True, False, False, False] and out["p"]["walk_ratio"] is None and out["p"]["damage_per_kill"] == 25


def test_chronology_and_splits(spark):
    meta = spark.createDataFrame([(f"m{i}", f"2026-01-{i + 1:02d} 00:00:00", 1, 0) for i in range(10)], "match_id string, t string, dates int, bad_dates int").withColumn("match_time", F.col("t").cast("timestamp_ntz"))
    assert C.chronology(meta, True) == "B" and C.chronology(meta, False) == "C"
    assert C.chronology(meta.withColumn("match_time", F.col("match_time") + F.expr("interval 1 hour")), True) == "A"
    n = {r["split"]: r["n"] for r in C.split_matches(meta, "B").groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {"train": 7, "validation": 2, "test": 1}
    assert C.split_matches(meta, "C").where("split = 'train'").count() == 7
    with pytest.raises(ValueError):
        C.split_matches(meta.limit(2), "B")


def test_allowlist():
    assert X.allowlist("t0", ["player_kills"]) == ["player_kills"]
    for task, c in (("t0", "early_kills"), ("s1", "player_survive_time"), ("p2", "team_placement")):
        with pytest.raises(ValueError):
            X.allowlist(task, [c])


def preds(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "row_id string, match_id string, team_id string, actual double, predicted double")


def test_metrics(spark):
    p = preds(spark, [("m", "t", 1.0, 1.0), ("m", "t", 2.0, 1.0), ("m", "u", 3.0, 1.0)])
    r = V.micro(p).first()
    assert (r["n"], r["mae"], round(r["rmse"], 12), round(r["r2"], 12)) == (3, 1.0, round(math.sqrt(5 / 3), 12), -1.5)
    assert V.micro(p.limit(1)).first()["r2"] is None
    big = spark.range(120000).select(F.col("id").cast("string").alias("row_id"), (F.col("id") / 8).cast("long").cast("string").alias("match_id"), (F.col("id") % 4).cast("string").alias("team_id"), ((F.col("id") % 4) / 3).alias("actual"))
    r = {x["aggregation"]: x for x in V.hierarchical(big.withColumn("predicted", F.col("actual") + 0.125)).collect()}
    assert [r[k]["n"] for k in ("micro", "match_aware", "team_aware")] == [120000, 120000, 60000]
    for x in r.values():
        assert x["mae"] == pytest.approx(0.125) and x["rmse"] == pytest.approx(0.125) and x["r2"] == pytest.approx(0.8875)


def test_bootstrap_of_constant_errors(spark):
    rows = [(str(i), str(i // 8), (i % 4) / 3) for i in range(400)]
    p = spark.createDataFrame(rows, "row_id string, match_id string, actual double").withColumns({"predicted_a": F.col("actual") + 0.125, "predicted_b": F.col("actual") + 0.0625})
    got = {r["metric"]: (r["lower"], r["upper"]) for r in V.bootstrap(p, 20).collect()}
    assert got["mae"] == pytest.approx((-0.0625, -0.0625)) and got["r2"] == pytest.approx((0.084375, 0.084375))
    with pytest.raises(ValueError):
        V.bootstrap(p, 5)


def test_guards(spark):
    with pytest.raises(ValueError):
        V.check_predictions(preds(spark, [("m", "t", 1.0, float("nan"))]))
    with pytest.raises(ValueError):
        p = preds(spark, [("m", "t", 1.0, 1.0)])
        V.check_predictions(p.union(p))
    with pytest.raises(Exception, match="conflicting"):
        V.team_aware(preds(spark, [("m", "t", 1.0, 1.0), ("m", "t", 2.0, 1.0)])).collect()
    cols = {"team_size_mode": F.lit("Solo"), "split": F.lit("test")}
    a, b = preds(spark, [("m", None, 1.0, 1.0)]).withColumns(cols), preds(spark, [("m", None, 2.0, 1.0)]).withColumns(cols)
    assert V.paired(a, a).count() == 1
    with pytest.raises(Exception, match="same rows"):
        V.paired(a, b).collect()


def test_regions_and_histogram(spark):
    p = preds(spark, [("m", "t", x, 0.0) for x in (0.0, 0.3, 0.31, 0.7, 1.0)]).withColumn("residual", F.col("actual"))
    assert [r[0] for r in p.select(V.region([0, 0.3, 0.7, 1.0])).collect()] == [0, 0, 1, 1, 2]
    h = V.residual_histogram(p).collect()
    assert len(h) == 20 and sum(r["n"] for r in h) == 5 and min(r["lower"] for r in h) == pytest.approx(-0.001)


def test_least_norm_for_collinear_columns(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=300), rng.normal(size=300)
    x = np.column_stack([a, b, a + b, np.zeros(300)])
    y = 2 * a - b + 0.5 + rng.normal(size=300) * 0.01
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, d double, y double").repartition(5)
    got, intercept, rank, n = M.least_squares(df, 4)
    want = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=None)[0]
    assert rank == 2 and n == 300 and np.allclose(got, want, atol=1e-9) and intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_inputs(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (3.0, None, 3.0), (None, None, 3.0)], "a double, b double, c double")
    i = M.fit_inputs(df, ["a", "b", "c"])
    assert i.means == {"a": 2.0, "b": 0.0, "c": 3.0} and i.indicated == ["a", "b"] and i.scale[:3] == [pytest.approx(math.sqrt(2 / 3)), 1.0, 1.0]
    model = M.fit_linear(df.withColumn("y", F.coalesce("a", F.lit(0.0))), ["a", "b", "c"], "y")
    assert df.withColumn("y", F.coalesce("a", F.lit(0.0))).select(F.max(F.abs(model.predict() - F.col("y")))).first()[0] < 1e-9
    with pytest.raises(ValueError):
        M.fit_inputs(spark.createDataFrame([(-1.0,)], "a double"), ["a"], ["a"])
    a = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "row_id string, actual double")
    assert M.same_cohort(a, a.orderBy(F.desc("row_id"))) and not M.same_cohort(a, a.limit(1))


def test_cluster_measures(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 6])
    labels = np.repeat([0, 1], 30)
    df = spark.createDataFrame([(i, [float(a), float(b)], int(k)) for i, ((a, b), k) in enumerate(zip(x, labels, strict=True))], "id long, z array<double>, cluster int")
    m = np.array([x[labels == k].mean(0) for k in (0, 1)])
    s = [np.linalg.norm(x[labels == k] - m[k], axis=1).mean() for k in (0, 1)]
    assert K.davies_bouldin(df) == pytest.approx((s[0] + s[1]) / np.linalg.norm(m[0] - m[1]))
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = np.mean([(b - a) / max(a, b) for i in range(60) for a, b in [(d[i][(labels == labels[i]) & (np.arange(60) != i)].mean(), d[i][labels != labels[i]].mean())]])
    assert K.silhouette(x, labels) == pytest.approx(want)
    assert K.adjusted_rand(df.withColumn("o", 1 - F.col("cluster")), "cluster", "o") == 1.0
    found = K.diagnose(df.drop("cluster"), "id", range(2, 4), restarts=2)
    assert K.choose(found) == 2 and found[0].silhouette == pytest.approx(want) and K.choose(found, 3) == 3


def test_shards(spark, tmp_path):
    (tmp_path / "a.csv").write_text('match_id,killer_name,victim_name,time,gun\nm1," x ",,12,"a\nb"\n,y,z,oops,c\n')
    rows = shards.ingest(spark, "event", str(tmp_path / "*.csv")).orderBy("source_row").collect()
    assert [(r["match_id"], r["killer_name"], r["victim_name"], r["event_time"], r["raw_gun"], r["source_row"], r["source_file"]) for r in rows] == [("m1", "x", None, 12.0, "a\nb", 0, "a.csv"), (None, "y", "z", None, "c", 1, "a.csv")]
    (tmp_path / "b.csv").write_text("match_id,killer_name,victim_name,time,event_time\n")
    with pytest.raises(ValueError):
        shards.ingest(spark, "event", str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("match_id\n")
    with pytest.raises(ValueError):
        shards.ingest(spark, "event", str(tmp_path / "c.csv"))
    with pytest.raises(FileNotFoundError):
        shards.discover(str(tmp_path / "none*"))


def test_rows_of_a_split_shard_are_numbered_in_order(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.csv").write_text("match_id,killer_name,victim_name,time\n" + "".join(f"m{i},k,v,{i}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = shards.ingest(spark, "event", str(tmp_path / "*" / "x.csv"))
        assert rows.where("match_id = concat('m', source_row) AND event_time = source_row").count() == 6000
        assert sorted(r[0] for r in rows.select("source_file").distinct().collect()) == ["a/x.csv", "b/x.csv"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
