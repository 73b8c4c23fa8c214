"""Session settings that the library relies on, and the sharing of its code with Python workers."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def build(master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution; master and sizes stay the caller's choice."""
    b = SparkSession.builder.appName("skirmish")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    fixed = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it by its own path.

    On a cluster the package is installed or sent with --py-files; this only helps workers on the driver's host.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where that is unset, one is made if the executors are
    threads of this process, as in tests; on a cluster it is an error, as executors would not see it."""
    sc = share_code(spark).sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and not sc._jsc.sc().isLocal():
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="skirmish-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder; a lost executor costs only a re-read."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
