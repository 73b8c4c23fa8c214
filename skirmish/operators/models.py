"""Imputation, scaling, baselines and least squares with a minimum-norm solution."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.functions.stats import if_finite, number_of
from skirmish.operators.eda import quantiles
from skirmish.session import share_code


@dataclass
class Inputs:
    """What turns raw feature columns into model inputs: logs, means for missing values, indicators, centres and scales."""

    features: list[str]
    logs: list[str] = field(default_factory=list)
    means: dict[str, float] = field(default_factory=dict)
    indicated: list[str] = field(default_factory=list)  # columns with a missing value in training
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.features, *(f"missingindicator_{c}" for c in self.indicated)]

    def raw(self, c: str) -> Column:
        x = F.col(c).cast("double")
        return if_finite(F.log1p(x) if c in self.logs else x)

    def imputed(self) -> list[Column]:
        filled = [F.coalesce(self.raw(c), F.lit(float(self.means[c]))).alias(c) for c in self.features]
        return [*filled, *(self.raw(c).isNull().cast("double").alias(f"missingindicator_{c}") for c in self.indicated)]

    def scaled(self) -> list[Column]:
        return [((x - F.lit(float(m))) / F.lit(float(s))).alias(n) for x, m, s, n in zip(self.imputed(), self.centre, self.scale, self.names, strict=True)]


def fit_inputs(train: DataFrame, features: list[str], logs: list[str] | None = None) -> Inputs:
    """Means, indicators and population scales from the training rows. A column without values is filled with 0; a constant
    one has scale 1; a negative value in a logged column is an error."""
    made = Inputs(features, logs or [])
    for c in made.logs:
        if not train.where(F.col(c) < 0).isEmpty():
            raise ValueError(f"{c} has negative values and cannot be logged")
    r = train.agg(*(F.avg(made.raw(c)).alias(f"m_{c}") for c in features), *(number_of(made.raw(c).isNull()).alias(f"n_{c}") for c in features)).first()
    made.means = {c: 0.0 if r[f"m_{c}"] is None else r[f"m_{c}"] for c in features}
    made.indicated = [c for c in features if r[f"n_{c}"]]
    x = train.select(*made.imputed())
    r = x.agg(*(f(F.col(f"`{n}`")).alias(f"{k}_{n}") for n in made.names for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    made.centre = [float(r[f"m_{n}"] or 0) for n in made.names]
    made.scale = [float(r[f"s_{n}"] or 1) for n in made.names]
    return made


def triangle(rows: DataFrame, width: int) -> np.ndarray:
    """R of the QR decomposition of a table of `width` double columns: blocks reduce to triangles on the executors, and those
    to one triangle in two more steps. What reaches the driver has width rows for each of a few tasks."""
    share_code(rows.sparkSession)
    schema = T.StructType([T.StructField("r", T.ArrayType(T.DoubleType()))])

    def reduce_rows(values: Iterator[np.ndarray]) -> np.ndarray:
        r = np.zeros((0, width))
        for x in values:
            r = np.linalg.qr(np.concatenate([r, x]), mode="r")
        return r

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduce_rows(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["r"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = reduce_rows(np.array(b.column("r").to_pylist()).reshape(-1, width) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(r), pa.list_(pa.float64()))], names=["r"])

    partial = rows.mapInArrow(first, schema).coalesce(64).mapInArrow(again, schema)
    found = [r["r"] for r in partial.collect()]
    return np.linalg.qr(np.array(found).reshape(-1, width), mode="r") if found else np.zeros((0, width))


@dataclass
class Linear:
    inputs: Inputs
    coefficients: list[float]
    intercept: float
    rank: int
    rows: int

    def predict(self) -> Column:
        total = F.lit(float(self.intercept))
        for z, b in zip(self.inputs.scaled(), self.coefficients, strict=True):
            total = total + z * F.lit(float(b))
        return total

    def table(self, spark) -> DataFrame:
        rows = [(n, float(b)) for n, b in zip(self.inputs.names, self.coefficients, strict=True)]
        return spark.createDataFrame([*rows, ("intercept", float(self.intercept))], "feature string, coefficient double")

    def to_json(self) -> dict:
        return asdict(self)

    @classmethod
    def from_json(cls, told: dict) -> Linear:
        return cls(**{**told, "inputs": Inputs(**told["inputs"])})


def least_squares(x: DataFrame, width: int) -> tuple[np.ndarray, float, int, int]:
    """(coefficients, intercept, rank, rows) of the last column on the others: centred, by a tall-skinny QR and an SVD of its
    triangle. Singular values up to max(rows, columns) times the machine precision of the largest count as 0, which gives the
    solution of least norm for collinear columns."""
    names = x.columns
    r = x.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names))).first()
    n = r["n"]
    if not n:
        raise ValueError("no rows to fit")
    mean = np.array([r[f"m{i}"] for i in range(width + 1)])
    centred = x.select(*((F.col(f"`{c}`") - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(names, mean, strict=True))))
    t = triangle(centred, width + 1)
    u, s, vt = np.linalg.svd(t[:, :width], full_matrices=False)
    keep = s > max(n, width) * np.finfo(float).eps * (s[0] if len(s) else 0)
    b = vt[keep].T @ ((u[:, keep].T @ t[:, width]) / s[keep])
    return b, float(mean[width] - mean[:width] @ b), int(keep.sum()), n


def fit_linear(train: DataFrame, features: list[str], target: str, logs: list[str] | None = None) -> Linear:
    inputs = fit_inputs(train, features, logs)
    b, intercept, rank, n = least_squares(train.select(*inputs.scaled(), F.col(target).cast("double").alias("_y")), len(inputs.names))
    return Linear(inputs, b.tolist(), intercept, rank, n)


def baseline(train: DataFrame, target: str, kind: str) -> float:
    """The training mean or the exact training median."""
    y = F.col(target).cast("double")
    return train.agg(F.avg(y).alias("v")).first()["v"] if kind == "mean" else quantiles(train, target, (0.5,)).first()[0]


def predictions(rows: DataFrame, target: str, predicted: Column, experiment: str) -> DataFrame:
    """Identity, actual, predicted and residual of each row."""
    y = F.col(target).cast("double")
    return rows.select("row_id", "match_id", "team_id", "team_size_mode", "split", y.alias("actual"), predicted.alias("predicted"), (y - predicted).alias("residual"), F.lit(experiment).alias("experiment"), F.lit(target).alias("target"))


def same_cohort(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same (row_id, actual), by counts and order-free checksums of both."""
    digest = lambda df: df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("row_id", "actual")), F.sum(F.xxhash64("row_id", "actual", F.lit(1)).cast("decimal(20,0)"))).first()
    return digest(a) == digest(b)
