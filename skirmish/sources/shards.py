"""Reading telemetry shards: discovery, all-text CSV, aliases, required columns, coercion with counters, lineage, merging."""

from __future__ import annotations

import glob as globbing
import os
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions.stats import blank_to_null, number_of, to_number

# The columns each group must have.
AGGREGATE = ["match_id", "player_name", "team_id", "date", "party_size", "game_size", "player_kills", "player_dmg", "player_assists", "player_dbno", "player_dist_walk", "player_dist_ride", "player_survive_time", "team_placement"]
COUNTS = ["party_size", "game_size", "player_kills", "player_assists", "player_dbno", "team_placement"]
EVENT = ["match_id", "killer_name", "victim_name", "event_time"]
TEXT = {"match_id", "player_name", "team_id", "date", "killer_name", "victim_name"}
ALIASES = {"aggregate": {}, "event": {"time": "event_time"}}
REQUIRED = {"aggregate": AGGREGATE, "event": EVENT}


def discover(*patterns: str) -> list[str]:
    """Every shard that the patterns match, resolved, sorted and once; none is an error. For folders the driver can list."""
    found = sorted({str(Path(p).resolve()) for pattern in patterns for p in globbing.glob(pattern)})
    if not found:
        raise FileNotFoundError(f"no shard matches {', '.join(patterns)}")
    return found


def root(*patterns: str) -> str:
    """The folder that source files are named from: what precedes the wildcards of all patterns."""
    fixed = []
    for p in patterns:
        parts = Path(p).parts
        wild = next((i for i, x in enumerate(parts) if any(c in x for c in "*?[")), len(parts) - 1)
        fixed.append(str(Path(*parts[:wild]).resolve()))
    return os.path.commonpath(fixed)


def header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV shard, from its first line."""
    return [f.name for f in spark.read.option("header", True).csv(path).limit(0).schema]


def read_csv(spark: SparkSession, path: str, named: str | None = None) -> DataFrame:
    """One CSV shard with every column as text, and its lineage: source_file (named, or else the file's name) and the 0-based
    source_row.

    A shard is split for reading, unless a value of it goes over several lines, which one look at its quotes tells. Rows are
    numbered by block and place: ids ascend within a block, and what precedes a block is a sum over one count per block.
    """
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    many = not spark.read.text(path).where(odd).isEmpty()
    rows = spark.read.schema(schema).options(header=True, multiLine=many, escape='"').csv(path)
    placed = rows.select("*", F.col("_metadata.file_block_start").alias(" block"), F.monotonically_increasing_id().alias(" id"))
    blocks = placed.groupBy(" block").agg(F.min(" id").alias(" first"), F.count(F.lit(1)).alias(" n"))
    before = F.coalesce(F.sum(" n").over(Window.orderBy(" block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(F.broadcast(blocks.select(" block", " first", before.alias(" before"))), " block")
    return out.select(*(f"`{n}`" for n in names), (F.col(" before") + F.col(" id") - F.col(" first")).alias("source_row"), F.lit(named or Path(path).name).alias("source_file"))


def renamed(rows: DataFrame, group: str) -> DataFrame:
    """Canonical names by the group's aliases, required columns first. A collision or a missing column is an error."""
    alias = ALIASES[group]
    names = [alias.get(c, c) for c in rows.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"several columns become {', '.join(twice)}")
    missing = [c for c in REQUIRED[group] if c not in names]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    out = rows.toDF(*names)
    return out.select(*REQUIRED[group], *(n for n in names if n not in REQUIRED[group]))


def coerced(rows: DataFrame, group: str) -> DataFrame:
    """Typed canonical columns next to the text they came from (raw_ columns, which make rows exact duplicates).

    Numbers that cannot be parsed or are not finite become null, as do fractional counts; identifiers are trimmed.
    """
    canonical: list[Column] = []
    for c in REQUIRED[group]:
        x = blank_to_null(F.col(c)) if c in TEXT else to_number(F.col(c))
        canonical.append((F.when(x % 1 == 0, x) if c in COUNTS else x).alias(c))
    raw = [F.col(c).alias(f"raw_{c}") for c in rows.columns if c not in ("source_file", "source_row")]
    return rows.select(*canonical, *raw, "source_file", "source_row")


def quality(column: str) -> list[Column]:
    """Aggregates over a text column: missing, parse_errors and non_integers."""
    text, value = blank_to_null(F.col(column)), to_number(F.col(column))
    return [number_of(text.isNull()).alias("missing"), number_of(text.isNotNull() & value.isNull()).alias("parse_errors"), number_of(value % 1 != 0).alias("non_integers")]


def parse_report(rows: DataFrame, group: str) -> DataFrame:
    """(source_file, column, original_missing, parse_error, non_integer, rows) of each required column of coerced rows, from
    one scan. Text has no parse errors, and only counts must be whole."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"raw_{c}").alias("t"), F.lit(c not in TEXT).alias("number"), F.lit(c in COUNTS).alias("whole")) for c in REQUIRED[group]))
    long = rows.select("source_file", F.explode(pairs).alias("p")).select("source_file", "p.*")
    text, value = blank_to_null(F.col("t")), to_number(F.col("t"))
    return long.groupBy("source_file", "column").agg(
        number_of(text.isNull()).alias("original_missing"), number_of(F.col("number") & text.isNotNull() & value.isNull()).alias("parse_error"),
        number_of(F.col("whole") & (value % 1 != 0)).alias("non_integer"), F.count(F.lit(1)).alias("rows"))


def inventory(rows: DataFrame) -> DataFrame:
    """Rows of each source file."""
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))


def sources(*patterns: str) -> dict[str, str]:
    """The path of each shard by its name from the root, so that equal file names of several folders stay apart."""
    top = root(*patterns)
    return {Path(os.path.relpath(p, top)).as_posix(): p for p in discover(*patterns)}


def schema_report(spark: SparkSession, group: str, *patterns: str) -> list[dict]:
    """The source column and the canonical column of every shard."""
    return [{"group": group, "file": n, "source_column": c, "canonical_column": ALIASES[group].get(c, c)} for n, p in sources(*patterns).items() for c in header(spark, p)]


def ingest(spark: SparkSession, group: str, *patterns: str) -> DataFrame:
    """All shards of a group, coerced and merged by name; columns that a shard lacks are null there."""
    shards = [coerced(renamed(read_csv(spark, p, n), group), group) for n, p in sources(*patterns).items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)
