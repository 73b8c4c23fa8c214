"""The stages from raw shards to comparisons, with content-addressed results: a stage runs again only if its configuration,
the library's code, the software's versions or what it reads has changed, or if a file of it is not as it was written. A
stage's folder appears whole or not at all."""

from __future__ import annotations

import hashlib
import json
import os
import platform
import shutil
import socket
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyspark
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skirmish.operators import clean as C
from skirmish.operators import clusters as K
from skirmish.operators import eda as E
from skirmish.operators import evaluate as V
from skirmish.operators import features as X
from skirmish.operators import models as M
from skirmish.operators import profiles as P
from skirmish.operators import timing as G
from skirmish.sources import shards, sinks

# What may be set, and what it is unless set.
DEFAULTS = {
    "aggregate": "data/aggregate/*.csv", "event": "data/event/*.csv", "declared_chronology": False, "ratios": [0.7, 0.15, 0.15], "seed": 42, "minimum_duration": 60.0,
    "minimum_games": 10, "clusters": list(range(2, 9)), "restarts": 10, "chosen_clusters": None, "logs": [], "region_shares": [0.0, 0.33, 0.67, 1.0], "bootstrap": 0, "gates": "auto",
    "confirmed_grade": None, "time_unit": {"status": "pending"},
}
PACKAGE = Path(__file__).resolve().parents[1]


class Pending(Exception):
    """A manual gate waits for a decision."""


@dataclass
class Context:
    spark: SparkSession
    folder: str
    options: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = set(self.options) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        self.options = DEFAULTS | self.options
        if abs(sum(self.options["ratios"]) - 1) > 1e-9 or min(self.options["ratios"]) <= 0:
            raise ValueError("ratios must be positive and sum to 1")
        self.events: list[dict] = []
        self.verified: set[tuple[str, str]] = set()  # stages whose files this context has compared with their checksums

    def path(self, stage: str, name: str = "") -> str:
        return str(Path(self.folder, stage, name))

    def read(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, name))

    def note(self, stage: str, status: str, **more: object) -> None:
        self.events = [*self.events, {"stage": stage, "status": status, "at": time.time(), **more}][-200:]


@dataclass
class Stage:
    name: str
    needs: tuple[str, ...]
    uses: tuple[str, ...]  # options
    reads: tuple[str, ...]  # options that name shards; their contents count, not where they are
    run: Callable[[Context, str], dict]  # writes into the folder it is given and returns small facts


STAGES: dict[str, Stage] = {}


def stage(*needs: str, uses: tuple[str, ...] = (), reads: tuple[str, ...] = ()) -> Callable:
    def add(f: Callable) -> Callable:
        STAGES[f.__name__] = Stage(f.__name__, needs, uses, reads, f)
        return f

    return add


@contextmanager
def lock(path: str):
    """Only one run at a time: the folder is the lock, and says whose it is. One that a dead process of this host left is
    taken over."""
    os.makedirs(Path(path).parent, exist_ok=True)
    owner, me = Path(path, "owner.json"), {"host": socket.gethostname(), "pid": os.getpid()}
    try:
        os.mkdir(path)
    except FileExistsError:
        held = json.loads(owner.read_text()) if owner.exists() else me
        if held["host"] != me["host"] or Path(f"/proc/{held['pid']}").exists() or not Path("/proc").exists():
            raise FileExistsError(f"{path} is held by process {held['pid']} on {held['host']}") from None
    owner.write_text(json.dumps(me))
    try:
        yield
    finally:
        shutil.rmtree(path)


def code_digest() -> str:
    """A digest of the library's sources; the corpus operators take no part in any stage."""
    h = hashlib.sha256()
    for p in sorted(PACKAGE.rglob("*.py")):
        name = p.relative_to(PACKAGE).as_posix()
        if not name.startswith("llm/"):
            h.update(f"{name}\0{sinks.checksum(p)}\n".encode())
    return h.hexdigest()


def signature(ctx: Context, s: Stage) -> str:
    """A digest of the library's code and software, the stage's options, the manifests of what it needs, and for the first
    stage the names and contents of all shards."""
    software = [platform.python_version(), pyspark.__version__, np.__version__]
    inputs = {n: sinks.read_json(ctx.path(n, "manifest.json"))["signature"] for n in s.needs}
    options = {u: ctx.options[u] for u in s.uses if not s.reads}
    files = {g: {n: sinks.checksum(Path(p)) for n, p in shards.sources(ctx.options[g]).items()} for g in s.reads}
    return hashlib.sha256(json.dumps([s.name, code_digest(), software, options, inputs, files], sort_keys=True).encode()).hexdigest()


def intact(ctx: Context, name: str, m: dict) -> bool:
    """Whether the files of a stage are those that it wrote."""
    if (name, m["signature"]) not in ctx.verified:
        there = {k: v for k, v in sinks.artifacts(ctx.path(name)).items() if k != "manifest.json"}
        if there != m.get("artifacts"):
            return False
        ctx.verified.add((name, m["signature"]))
    return True


def run(ctx: Context, name: str) -> dict:
    """The manifest of a stage, run if it has to be; the stages that it needs come first."""
    s = STAGES[name]
    for n in s.needs:
        run(ctx, n)
    want, manifest = signature(ctx, s), Path(ctx.path(name, "manifest.json"))
    if manifest.exists() and (m := sinks.read_json(str(manifest)))["signature"] == want and m["status"] == "completed" and intact(ctx, name, m):
        ctx.note(name, "reused")
        return m
    with lock(f"{ctx.folder}/.{name}.lock"):
        staged = f"{ctx.folder}/.{name}.staged"
        shutil.rmtree(staged, ignore_errors=True)
        os.makedirs(staged)
        ctx.note(name, "running")
        try:
            facts = s.run(ctx, staged)
        except Exception as e:
            ctx.note(name, "pending" if isinstance(e, Pending) else "failed", error=str(e)[:500])
            raise
        m = {"stage": name, "signature": want, "status": "completed", "facts": facts, "artifacts": sinks.artifacts(staged)}
        sinks.write_json(f"{staged}/manifest.json", m)
        shutil.rmtree(ctx.path(name), ignore_errors=True)
        os.replace(staged, ctx.path(name))
        ctx.verified.add((name, want))
        ctx.note(name, "completed")
    return m


@stage(reads=("aggregate", "event"))
def ingest(ctx: Context, out: str) -> dict:
    facts, reports = {}, {"inventory": [], "parse": [], "schema": [], "storage": []}
    for group in ("aggregate", "event"):
        rows = shards.ingest(ctx.spark, group, ctx.options[group])
        sinks.write_parquet(rows, f"{out}/{group}")
        written = ctx.spark.read.parquet(f"{out}/{group}")
        facts[group] = {r["source_file"]: r["rows"] for r in shards.inventory(written).collect()}
        paths = shards.sources(ctx.options[group])
        if empty := sorted(set(paths) - set(facts[group])):
            raise ValueError(f"shards without rows: {', '.join(empty)}")
        reports["inventory"] += [{"group": group, "file": n, "rows": facts[group][n], "bytes": os.path.getsize(p), "sha256": sinks.checksum(Path(p))} for n, p in paths.items()]
        reports["parse"] += [{"group": group, **r.asDict()} for r in shards.parse_report(written, group).orderBy("source_file", "column").collect()]
        reports["schema"] += shards.schema_report(ctx.spark, group, ctx.options[group])
        reports["storage"].append({"group": group, "rows": sum(facts[group].values()), "shards": len(paths), "canonical_bytes": sum(f["bytes"] for f in sinks.artifacts(f"{out}/{group}").values())})
    for name, rows in reports.items():
        sinks.write_json(f"{out}/{name}.json", rows)
    return facts


@stage("ingest", uses=("declared_chronology", "ratios", "seed", "gates", "confirmed_grade"))
def clean(ctx: Context, out: str) -> dict:
    rows = ctx.read("ingest", "aggregate")
    numeric = [c for c in shards.AGGREGATE if c not in shards.TEXT]
    kept = C.clean(rows, numeric)
    sinks.write_parquet(C.match_metadata(kept), f"{out}/metadata")
    meta = ctx.spark.read.parquet(f"{out}/metadata")
    grade = C.chronology(meta, ctx.options["declared_chronology"])
    if ctx.options["gates"] == "manual" and ctx.options["confirmed_grade"] != grade:
        raise Pending(f"chronology looks like grade {grade}; confirm it with the option confirmed_grade")
    sinks.write_parquet(C.split_matches(meta, grade, tuple(ctx.options["ratios"]), ctx.options["seed"]), f"{out}/split")
    split = ctx.spark.read.parquet(f"{out}/split")
    named = C.with_identity(kept.join(split, "match_id"))
    sinks.write_parquet(named, f"{out}/cleaned")
    cleaned = ctx.spark.read.parquet(f"{out}/cleaned")
    ids = cleaned.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("ids")).first()
    if ids["n"] != ids["ids"]:
        raise ValueError("row ids are not unique")
    ledger = [r.asDict() for r in C.removal_ledger(rows, numeric).collect()]
    return {"grade": grade, "ledger": ledger, "rows": ids["n"], "matches": {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}}


@stage("clean", uses=("minimum_duration", "time_unit", "gates"))
def features(ctx: Context, out: str) -> dict:
    unit = G.time_unit(ctx.options["time_unit"])
    if ctx.options["gates"] == "manual" and not unit["accepted"]:
        raise Pending("the source's time unit is neither verified nor an approved assumption; see the option time_unit")
    sinks.write_json(f"{out}/time_unit.json", unit)
    sinks.write_csv(X.feature_dictionary(ctx.spark), f"{out}/feature_dictionary.csv")
    rows, meta = ctx.read("clean", "cleaned"), ctx.read("clean", "metadata")
    times = G.timing(ctx.read("ingest", "event"), meta, ctx.options["minimum_duration"])
    wide = G.with_timing(X.base_features(rows, meta), times)
    sinks.write_parquet(wide, f"{out}/player_match")
    written = ctx.spark.read.parquet(f"{out}/player_match")
    C.assert_row_count(written, rows)
    for name, report in {"coverage": G.coverage(written), "phase_summary": G.phase_summary(written), "discrepancy": G.discrepancy_summary(written), "event_diagnostics": G.event_diagnostics(ctx.read("ingest", "event"), meta)}.items():
        sinks.write_csv(report, f"{out}/{name}.csv")
    return X.feature_validation(written).first().asDict()


@stage("features")
def explore(ctx: Context, out: str) -> dict:
    rows = E.development(ctx.read("features", "player_match"))
    columns = [*X.TASKS["p2"], "player_survive_time", "normalized_placement"]
    sinks.write_csv(E.statistics(rows, columns, {"player_survive_time": "valid_survival"}), f"{out}/eda_statistics.csv")
    sinks.write_csv(E.mode_statistics(rows, X.BASE), f"{out}/mode_statistics.csv")
    for c in ("player_kills", "player_dmg", "total_distance", "player_survive_time", "normalized_placement"):
        sinks.figure(E.histogram(rows, c), f"{out}/histogram_{c}", "bar", c, x="lower", y="n")
    return {"rows": rows.count()}


@stage("features", uses=("time_unit",))
def relate(ctx: Context, out: str) -> dict:
    rows = ctx.read("features", "player_match")
    found = E.relationships(rows, {"player_survive_time": "valid_survival", "normalized_placement": "valid_placement"}, X.TASKS["p2"], X.PHASE, G.time_unit(ctx.options["time_unit"])["status"])
    sinks.write_csv(found, f"{out}/relationships.csv")
    return {"pairs": found.count()}


@stage("features", uses=("minimum_games", "clusters", "restarts", "chosen_clusters", "gates"))
def cluster(ctx: Context, out: str) -> dict:
    rows, least = ctx.read("features", "player_match"), ctx.options["minimum_games"]
    dev = P.profiles(rows)
    sinks.write_csv(P.retention(dev), f"{out}/retention.csv")
    facts: dict = {}
    for mode in C.MODES.values():
        one = dev.where((F.col("team_size_mode") == mode) & (F.col("games") >= least))
        if one.limit(3).count() < 3:
            facts[mode] = {"status": "too few players"}
            continue
        inputs = M.fit_inputs(one, P.PROFILE_FEATURES)
        scaled = lambda df, i=inputs: df.withColumn("z", F.array(*i.scaled()))
        found = K.diagnose(scaled(one), "player_name", ctx.options["clusters"], restarts=ctx.options["restarts"])
        if ctx.options["gates"] == "manual" and ctx.options["chosen_clusters"] is None:
            raise Pending("choose the number of clusters")
        k = K.choose(found, ctx.options["chosen_clusters"])
        sinks.write_json(f"{out}/selection_{mode}.json", {"k": k, "diagnostics": [{a: b for a, b in d.__dict__.items() if b == b} for d in found]})  # before outcomes are seen
        full = P.profiles(rows, development_only=False).where((F.col("team_size_mode") == mode) & (F.col("games") >= least))
        model = K.k_means(scaled(one), k, K.SEEDS[0], ctx.options["restarts"])
        model.write().overwrite().save(f"{out}/model_{mode}")
        sinks.write_parquet(K.labelled(scaled(full), model).drop("z"), f"{out}/assignments_{mode}")
        again = K.labelled(scaled(full), KMeansModel.load(f"{out}/model_{mode}")).select("player_name", F.col("cluster").alias("_again"))
        if not again.join(ctx.spark.read.parquet(f"{out}/assignments_{mode}"), "player_name").where("cluster <> _again").isEmpty():
            raise ValueError(f"the stored model of {mode} labels players differently")
        sinks.write_csv(K.cluster_tables(ctx.spark.read.parquet(f"{out}/assignments_{mode}"), P.PROFILE_FEATURES, ["mean_survival", "mean_placement"]), f"{out}/clusters_{mode}.csv")
        facts[mode] = {"k": k}
    return facts


EXPERIMENTS = [("s1", "mean"), ("s1", "median"), ("s1", "linear"), ("p2", "mean"), ("p2", "median"), ("p2", "linear"), ("t0", "linear")]


@stage("features", uses=("logs", "region_shares"))
def predict(ctx: Context, out: str) -> dict:
    rows, facts = ctx.read("features", "player_match"), {}
    for task, kind in EXPERIMENTS:
        target = X.TARGETS[task]
        valid = rows.where(F.col("valid_survival" if task == "s1" else "valid_placement"))
        train = valid.where("split = 'train'")
        name = f"{task}_{kind}"
        if kind == "linear":
            model = M.fit_linear(train, X.allowlist(task, X.TASKS[task]), target, [c for c in ctx.options["logs"] if c in X.TASKS[task]])
            sinks.write_json(f"{out}/{name}.json", model.to_json())
            if M.Linear.from_json(sinks.read_json(f"{out}/{name}.json")) != model:
                raise ValueError(f"the stored model of {name} differs from the fitted one")
            value = model.predict()
        else:
            constant = M.baseline(train, target, kind)
            sinks.write_json(f"{out}/{name}.json", {"value": constant})
            value = F.lit(constant)
        sinks.write_parquet(M.predictions(valid.where("split <> 'train'"), target, value, name), f"{out}/predictions/experiment={name}")
        p = ctx.spark.read.parquet(f"{out}/predictions/experiment={name}")
        V.check_predictions(p)
        facts[name] = {s: [r.asDict() for r in V.hierarchical(p.where(F.col("split") == s), task != "s1").collect()] for s in ("validation", "test")}
        edges = E.quantiles(train, target, tuple(ctx.options["region_shares"])).first()
        facts[name]["edges"] = list(edges)
    read = lambda n: ctx.spark.read.parquet(f"{out}/predictions/experiment={n}")
    for split in ("validation", "test"):
        if not M.same_cohort(*(read(n).where(F.col("split") == split) for n in ("t0_linear", "p2_linear"))):
            raise ValueError(f"t0 and p2 predict different rows of {split}")
    return facts


@stage("predict", uses=("bootstrap",))
def compare(ctx: Context, out: str) -> dict:
    side = lambda n: ctx.read("predict", f"predictions/experiment={n}").where("split = 'test'")
    pairs = V.paired(side("t0_linear"), side("p2_linear"))
    sinks.write_csv(V.deltas(pairs), f"{out}/deltas.csv")
    edges = sinks.read_json(ctx.path("predict", "manifest.json"))["facts"]["p2_linear"]["edges"]
    sinks.write_csv(V.error_slices(side("p2_linear"), edges), f"{out}/error_slices.csv")
    sinks.write_csv(V.residual_histogram(side("p2_linear")), f"{out}/residuals.csv")
    sinks.figure(V.plot_sample(side("p2_linear").select("row_id", "actual", "predicted")), f"{out}/sample", "scatter", "actual and predicted", x="actual", y="predicted")
    if ctx.options["bootstrap"]:
        sinks.write_csv(V.bootstrap(pairs, ctx.options["bootstrap"]), f"{out}/intervals.csv")
    return {"rows": pairs.count()}


@stage("clean", "features", "explore", "relate", "cluster", "predict", "compare")
def finish(ctx: Context, out: str) -> dict:
    """What the release holds: the manifests of all stages. sinks.release then copies the folder."""
    manifests = {n: sinks.read_json(ctx.path(n, "manifest.json")) for n in STAGES["finish"].needs}
    sinks.write_json(f"{out}/summary.json", manifests)
    return {n: m["signature"] for n, m in manifests.items()}


