"""Numeric feature matrices and their moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import numeric_columns, present_double, quoted


def assemble(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (), fill: str = "zero") -> DataFrame:
    """``keep`` columns and vector ``raw``; gaps become 0 or the column mean."""
    columns = [c for c in numeric_columns(df, columns) if c not in keep]
    if not columns:
        raise ValueError("no numeric columns")
    if fill == "mean":
        from tablewright.operators.cleaning import impute

        df = impute(df, "mean", columns)
    parts = df.select(*[quoted(k) for k in keep], *[F.coalesce(present_double(df, c), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(columns)])
    names = [f"_f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=names, outputCol="raw").transform(parts).drop(*names)


def scale(df: DataFrame) -> DataFrame:
    """Add ``features``: zero mean and unit deviation per column of ``raw``."""
    model = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(df)
    return model.transform(df)


def scaled(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = (), fill: str = "zero") -> DataFrame:
    return scale(assemble(df, columns, keep, fill))


def arrays(df: DataFrame, keep: Sequence[str] = (), vector: str = "features") -> DataFrame:
    """The vector column as ``x``: array<double>."""
    return df.select(*[quoted(k) for k in keep], vector_to_array(vector).alias("x"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


def batch_sums(df: DataFrame, fn, size: int) -> np.ndarray:
    """Sum of ``fn(frame) -> vector of length size`` over all batches.

    Each task adds up its batches and emits one vector; Spark adds those per
    position, and ``size`` numbers come to the driver.
    """

    def run(frames):
        total = np.zeros(size)
        for frame in frames:
            if len(frame):
                total += fn(frame)
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    rows = df.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def width(df: DataFrame, column: str = "x") -> int:
    first = df.select(F.size(column).alias("d")).first()
    if first is None:
        raise ValueError("no rows")
    return first["d"]


def covariance(df: DataFrame, d: int, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Row count (or weight), mean and population covariance of array column ``x``."""

    def sums(frame: pd.DataFrame) -> np.ndarray:
        x = matrix(frame["x"])
        w = np.ones(len(x)) if weight is None else frame[weight].to_numpy(dtype=float)
        return np.concatenate([[w.sum()], w @ x, (x.T @ (x * w[:, None])).ravel()])

    cols = ["x"] if weight is None else ["x", weight]
    total = batch_sums(df.select(*cols), sums, 1 + d + d * d)
    n = total[0]
    mean = total[1 : 1 + d] / n
    return n, mean, total[1 + d :].reshape(d, d) / n - np.outer(mean, mean)
