"""Dimensionality reduction: principal, independent and discriminant components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.features import arrays, batch_sums, covariance, matrix, scaled, width
from tablewright.session import stage

SEED = 42


def _fixed_sign(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that their largest entry is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.sign(vectors[top, np.arange(vectors.shape[1])])


def project(df: DataFrame, mean: np.ndarray, basis: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``component_1 ..`` of every row: (x - mean) times a small fixed matrix."""
    k = basis.shape[1]
    shift = mean @ basis
    parts = [
        (F.aggregate(F.zip_with("x", F.lit([float(v) for v in basis[:, j]]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) - float(shift[j])).alias(f"component_{j + 1}")
        for j in range(k)
    ]
    return df.select(*keep, *parts)


def spectrum(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()):
    """Scaled rows with mean, eigenvalues and eigenvectors of their covariance."""
    rows = arrays(scaled(df, columns, keep), keep)
    d = width(rows)
    n, mean, cov = covariance(rows, d)
    values, vectors = np.linalg.eigh(cov * n / max(n - 1, 1))
    order = np.argsort(values)[::-1]
    return rows, mean, np.clip(values[order], 0, None), _fixed_sign(vectors[:, order])


def _count(values: np.ndarray, components: int | None, variance: float) -> int:
    if components is not None:
        return min(components, len(values))
    share = np.cumsum(values) / values.sum()
    return int(min(len(values), np.searchsorted(share, variance) + 1))


def pca(df: DataFrame, key: str, columns: Sequence[str] | None = None, components: int | None = None, variance: float = 0.95) -> DataFrame:
    """Projection on the leading components, by number or by share of variance."""
    rows, mean, values, vectors = spectrum(df, columns, [key])
    return project(rows, mean, vectors[:, : _count(values, components, variance)], [key])


def component_info(df: DataFrame, columns: Sequence[str] | None = None, targets: Sequence[float] = (0.8, 0.9, 0.95, 0.99)) -> DataFrame:
    """Variance share of each component, running share, and the targets it reaches first."""
    _, _, values, _ = spectrum(df, columns)
    share = values / values.sum()
    running = np.cumsum(share)
    rows = []
    for i, (v, s, r) in enumerate(zip(values, share, running)):
        reached = [t for t in targets if r >= t and (i == 0 or running[i - 1] < t)]
        rows.append((i + 1, float(v), float(s), float(r), [float(t) for t in reached]))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, ratio double, cumulative double, reaches array<double>")


def ica(df: DataFrame, key: str, columns: Sequence[str] | None = None, components: int = 2, max_iter: int = 200, tolerance: float = 1e-4) -> DataFrame:
    """Independent components by the symmetric fixed-point method (tanh contrast).

    Rows are whitened once and kept; every round is one pass that adds up a
    components x components matrix.
    """
    rows, mean, values, vectors = spectrum(df, columns, [key])
    k = min(components, int((values > 1e-12).sum()))
    white = vectors[:, :k] / np.sqrt(values[:k])
    z = stage(rows.select(key, "x"))
    w = np.linalg.qr(np.random.default_rng(SEED).normal(size=(k, k)))[0]

    def decorrelate(m: np.ndarray) -> np.ndarray:
        s, u = np.linalg.eigh(m @ m.T)
        return u @ np.diag(1.0 / np.sqrt(np.clip(s, 1e-15, None))) @ u.T @ m

    for _ in range(max_iter):
        current = w

        def step(frame: pd.DataFrame) -> np.ndarray:
            data = (matrix(frame["x"]) - mean) @ white
            g = np.tanh(data @ current.T)
            return np.concatenate([[len(data)], (g.T @ data).ravel(), (1 - g**2).sum(axis=0)])

        total = batch_sums(z.select("x"), step, 1 + k * k + k)
        n = total[0]
        new = decorrelate(total[1 : 1 + k * k].reshape(k, k) / n - np.diag(total[1 + k * k :] / n) @ w)
        moved = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1))
        w = new
        if moved < tolerance:
            break
    return project(z, mean, _fixed_sign(white @ w.T), [key])


def lda(df: DataFrame, key: str, label: str, columns: Sequence[str] | None = None, components: int | None = None) -> DataFrame:
    """Linear discriminants: class means and pooled covariance from one pass each."""
    rows = stage(arrays(scaled(df, columns, [key, label]), [key, label]))
    d = width(rows)
    n, mean, cov = covariance(rows, d)
    means = (
        rows.select(label, F.posexplode("x").alias("i", "v"))
        .groupBy(label, "i")
        .agg(F.avg("v").alias("m"), F.count("v").alias("n"))
        .collect()
    )
    classes = sorted({r[label] for r in means})
    table, sizes = np.zeros((len(classes), d)), np.zeros(len(classes))
    for r in means:
        c = classes.index(r[label])
        table[c, r["i"]], sizes[c] = r["m"], r["n"]
    between = (table - mean).T @ ((table - mean) * (sizes / n)[:, None])
    within = cov - between
    s, u = np.linalg.eigh(within)
    keep = s > 1e-10
    white = u[:, keep] / np.sqrt(s[keep])
    values, vectors = np.linalg.eigh(white.T @ between @ white)
    k = min(components or d, len(classes) - 1, d)
    basis = _fixed_sign(white @ vectors[:, np.argsort(values)[::-1][:k]])
    return project(rows, mean, basis, [key, label])


def compare(df: DataFrame, key: str, columns: Sequence[str] | None = None, components: int = 2) -> DataFrame:
    """Variance of the projections by method."""
    parts = None
    for name, run in (("pca", pca), ("ica", ica)):
        out = run(df, key, columns, components)
        names = [c for c in out.columns if c != key]
        row = out.agg(F.count(F.lit(1)).alias("n"), sum((F.var_samp(c) for c in names[1:]), F.var_samp(names[0])).alias("variance"))
        row = row.select(F.lit(name).alias("method"), F.lit(len(names)).alias("components"), "n", "variance")
        parts = row if parts is None else parts.unionByName(row)
    return parts
