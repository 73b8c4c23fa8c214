import json
import shutil
import socket
import subprocess

import pytest

from skirmish.plans import stages as S
from skirmish.sources import sinks
from tests import fixture


@pytest.fixture(scope="module")
def ctx(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("telemetry")
    a, e = fixture.write(folder / "data")
    return S.Context(spark, str(folder / "out"), {"aggregate": a, "event": e, "declared_chronology": True, "minimum_games": 2, "clusters": [2], "restarts": 1, "bootstrap": 20})


def test_all_stages(ctx):
    S.run(ctx, "finish")
    facts = {n: sinks.read_json(ctx.path(n, "manifest.json"))["facts"] for n in S.STAGES}
    assert sum(facts["ingest"]["aggregate"].values()) == 241 and sum(facts["ingest"]["event"].values()) == 360
    assert facts["clean"]["grade"] == "B" and facts["clean"]["rows"] == 240
    assert facts["clean"]["matches"] == {"train": 21, "validation": 5, "test": 4}
    assert [r["removed"] for r in facts["clean"]["ledger"]] == [1, 0, 0]
    assert facts["features"]["rows"] == 240 and facts["features"]["placement_outside"] == 0
    assert facts["cluster"]["Solo"] == {"k": 2} and facts["compare"]["rows"] == 32
    assert facts["predict"]["t0_linear"]["test"][0]["r2"] is not None


def test_results_are_reused_until_an_option_changes(ctx):
    S.run(ctx, "features")
    assert {e["status"] for e in ctx.events[-3:]} == {"reused"}
    before = sinks.read_json(ctx.path("features", "manifest.json"))["signature"]
    other = S.Context(ctx.spark, ctx.folder, {**{k: ctx.options[k] for k in ("aggregate", "event", "declared_chronology")}, "minimum_duration": 90.0})
    assert S.signature(other, S.STAGES["features"]) != before


def test_reports_and_gates(ctx, tmp_path):
    S.run(ctx, "features")
    read = lambda n: sinks.read_json(ctx.path("ingest", f"{n}.json"))
    assert [(r["group"], r["file"]) for r in read("inventory")] == [(g, f"shard{i}.csv") for g in ("aggregate", "event") for i in (0, 1)] and sum(r["rows"] for r in read("inventory")) == 601
    assert {r["column"] for r in read("parse") if r["group"] == "event"} == {"match_id", "killer_name", "victim_name", "event_time"} and not any(r["parse_error"] for r in read("parse"))
    assert {"group": "event", "file": "shard1.csv", "source_column": "time", "canonical_column": "event_time"} in read("schema") and [r["shards"] for r in read("storage")] == [2, 2]
    assert sinks.read_json(ctx.path("features", "time_unit.json"))["accepted"] is False and sinks.read_table(ctx.spark, ctx.path("features", "event_diagnostics.csv")).count() == 1
    manual = lambda **o: S.Context(ctx.spark, str(tmp_path / "m"), {**{k: ctx.options[k] for k in ("aggregate", "event", "declared_chronology")}, "gates": "manual", **o})
    with pytest.raises(S.Pending, match="grade B"):
        S.run(manual(), "clean")
    assert S.run(manual(confirmed_grade="B"), "clean")["facts"]["grade"] == "B"
    with pytest.raises(S.Pending, match="time unit"):
        S.run(manual(confirmed_grade="B"), "features")
    told = {"status": "assumed_seconds", "evidence": "a sample", "approved": True, "dataset": "d", "version": 3, "scope": "d/versions/3"}
    assert S.run(manual(confirmed_grade="B", time_unit=told), "features")["status"] == "completed"
    with pytest.raises(S.Pending, match="time unit"):
        S.run(manual(confirmed_grade="B", time_unit={**told, "version": 4}), "features")


def test_changes_force_a_rerun(spark, tmp_path, monkeypatch):
    a, e = fixture.write(tmp_path / "data")
    made = lambda: S.Context(spark, str(tmp_path / "out"), {"aggregate": a, "event": e, "declared_chronology": True})

    def done():
        c = made()
        S.run(c, "clean")
        return [(x["stage"], x["status"]) for x in c.events if x["status"] != "running"]

    fresh, reused = [("ingest", "completed"), ("clean", "completed")], [("ingest", "reused"), ("clean", "reused")]
    assert done() == fresh and done() == reused
    part = next((tmp_path / "out" / "clean" / "split").glob("part-*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    assert done() == [reused[0], fresh[1]] and done() == reused
    shard = tmp_path / "data" / "event" / "shard0.csv"
    shard.write_text(shard.read_text() + "rifle,match1,player1,other9,77\n")
    assert done() == fresh
    (tmp_path / "data" / "event" / "shard9.csv").write_text(shard.read_text())
    assert done() == fresh and done() == reused
    package = tmp_path / "package"
    shutil.copytree(S.PACKAGE, package, ignore=shutil.ignore_patterns("__pycache__"))
    monkeypatch.setattr(S, "PACKAGE", package)
    assert done() == reused
    (package / "operators" / "clean.py").write_text((package / "operators" / "clean.py").read_text() + "# changed\n")
    assert done() == fresh


def test_lock_of_a_dead_process_is_taken_over(tmp_path):
    gone = subprocess.Popen(["true"])
    gone.wait()
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "owner.json").write_text(json.dumps({"host": socket.gethostname(), "pid": gone.pid}))
    with S.lock(str(tmp_path / "l")):
        pass
    assert not (tmp_path / "l").exists()
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "owner.json").write_text(json.dumps({"host": "elsewhere", "pid": gone.pid}))
    with pytest.raises(FileExistsError, match="elsewhere"), S.lock(str(tmp_path / "l")):
        pass


def test_publish_restores_what_was_there(tmp_path, monkeypatch):
    path = tmp_path / "f"
    sinks.publish(str(path), b"old")
    kept, calls = sinks.checksum, []
    monkeypatch.setattr(sinks, "checksum", lambda p: (calls.append(p), kept(p) if len(calls) == 1 else "bad")[1])
    with pytest.raises(OSError):
        sinks.publish(str(path), b"new")
    assert path.read_bytes() == b"old" and [p.name for p in tmp_path.iterdir()] == ["f"]


def test_unknown_option_and_lock(ctx, tmp_path):
    with pytest.raises(ValueError):
        S.Context(ctx.spark, "x", {"colour": 1})
    with S.lock(str(tmp_path / "l")), pytest.raises(FileExistsError), S.lock(str(tmp_path / "l")):
        pass


def test_release(ctx, tmp_path):
    sinks.release(ctx.path("explore"), str(tmp_path / "r"))
    assert sinks.open_release(str(tmp_path / "r"))["files"]
    (tmp_path / "r" / "eda_statistics.csv").write_text("x")
    with pytest.raises(ValueError):
        sinks.open_release(str(tmp_path / "r"))


def test_sinks(spark, tmp_path):
    rows = spark.range(100).selectExpr("id", "cast(id % 7 as string) k")
    sinks.write_buckets(rows, str(tmp_path / "b"), "k", 4)
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.groupBy("k").agg({"bucket": "min"}).count() == 7 == back.select("k", "bucket").distinct().count()
    assert sinks.table_fingerprint(rows) == sinks.table_fingerprint(back.drop("bucket").orderBy("k"))
    sinks.write_csv(rows, str(tmp_path / "t.csv"))
    assert sinks.read_table(spark, str(tmp_path / "t.csv")).count() == 100
    with pytest.raises(ValueError):
        sinks.figure(rows, str(tmp_path / "f"), "pie", "no")
