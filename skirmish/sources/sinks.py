"""Writing tables, manifests and releases, so that readers see whole results only."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Compressed Parquet through Spark's committer; `by` makes one folder per value, each written by few tasks."""
    out = (rows.repartition(*by) if by else rows).write.option("compression", "zstd").mode("overwrite")
    (out.partitionBy(*by) if by else out).parquet(path)


def write_buckets(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Parquet in folders by a hash of the key, so that all rows of a key are in one."""
    from skirmish.functions.stats import hash_bucket

    write_parquet(rows.withColumn("bucket", hash_bucket(F.col(key), buckets)), path, ["bucket"])


def write_csv(rows: DataFrame, path: str, small: bool = True) -> None:
    """A report table: one file, in the order of its columns, if small; else Spark's part files."""
    if small:
        publish(path, rows.orderBy(*rows.columns).toPandas().to_csv(index=False).encode())
    else:
        rows.write.option("header", True).mode("overwrite").csv(path)


def publish(path: str, data: bytes) -> str:
    """Write a file beside its place, check it, and move it there; a failure leaves what was there. Returns the checksum."""
    target, staged, before = Path(path), Path(f"{path}.{os.getpid()}.staged"), Path(f"{path}.{os.getpid()}.before")
    target.parent.mkdir(parents=True, exist_ok=True)
    want = hashlib.sha256(data).hexdigest()
    try:
        staged.write_bytes(data)
        if checksum(staged) != want:
            raise OSError(f"{staged} differs from what was written")
        if target.exists():
            shutil.copy2(target, before)
        os.replace(staged, target)
        if checksum(target) != want:
            target.unlink()
            if before.exists():
                os.replace(before, target)
            raise OSError(f"{target} differs from what was written")
    finally:
        staged.unlink(missing_ok=True)
        before.unlink(missing_ok=True)
    return want


def artifacts(folder: str) -> dict[str, dict]:
    """Size and checksum of every file below a folder, by its name from there."""
    return {p.relative_to(folder).as_posix(): {"bytes": p.stat().st_size, "sha256": checksum(p)} for p in sorted(Path(folder).rglob("*")) if p.is_file()}


def checksum(path: Path) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while piece := f.read(1 << 20):
            h.update(piece)
    return h.hexdigest()


def write_json(path: str, value: object) -> str:
    return publish(path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n").encode())


def read_json(path: str) -> object:
    return json.loads(Path(path).read_text())


def read_yaml(path: str) -> dict:
    return yaml.safe_load(Path(path).read_text())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet, CSV or JSON table by its suffix."""
    kind = Path(path).suffix.lstrip(".") or "parquet"
    return spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.json(path) if kind == "json" else spark.read.parquet(path)


def table_fingerprint(rows: DataFrame) -> str:
    """An order-free fingerprint of a table's rows and column names."""
    names = sorted(rows.columns)
    r = rows.select(F.xxhash64(F.to_json(F.struct(*names), {"ignoreNullFields": "false"})).alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(json.dumps([names, [str(x) for x in r]]).encode()).hexdigest()


def figure(rows: DataFrame, path: str, kind: str, title: str, **axes: str) -> None:
    """The table and description of a figure, for any plotting tool; kind is bar, heatmap or scatter."""
    if kind not in ("bar", "heatmap", "scatter"):
        raise ValueError(f"unknown kind of figure: {kind}")
    write_csv(rows, f"{path}.csv")
    write_json(f"{path}.json", {"kind": kind, "title": title, "axes": axes, "columns": rows.columns})


def release(source: str, target: str) -> dict:
    """An immutable copy of a folder with a manifest of sizes and checksums. An existing release is an error."""
    if Path(target).exists():
        raise FileExistsError(f"{target} is already released")
    staged = f"{target}.{os.getpid()}.staged"
    shutil.copytree(source, staged)
    files = {str(p.relative_to(staged)): {"bytes": p.stat().st_size, "sha256": checksum(p)} for p in sorted(Path(staged).rglob("*")) if p.is_file()}
    manifest = {"files": files}
    write_json(f"{staged}/release.json", manifest)
    os.replace(staged, target)
    return manifest


def open_release(path: str) -> dict:
    """A release's manifest, after all its files were found as released."""
    manifest = read_json(f"{path}/release.json")
    there = {str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file()} - {"release.json"}
    if there != set(manifest["files"]):
        raise ValueError(f"files differ from the release: {sorted(there ^ set(manifest['files']))}")
    for name, f in manifest["files"].items():
        if checksum(Path(path, name)) != f["sha256"]:
            raise ValueError(f"{name} differs from the release")
    return manifest
