"""Model-based anomaly detectors: each gives ``(key, score, label)``.

Higher scores are stranger; the given share of rows is labelled -1. Models are
small (a forest of short trees, a mean and covariance, a weight vector) and are
fitted from bounded samples or summed statistics; scoring is one pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.probability import gamma_tail
from tablewright.operators.columns import numeric_columns
from tablewright.operators.features import arrays, batch_sums, covariance, matrix, scaled, width
from tablewright.operators.outliers import anomaly_stats, compare_methods, row_zscore, vote, vote_summary
from tablewright.operators.quantiles import with_quantiles
from tablewright.session import attach, spread, stage

SEED = 42
TREES = 100
SAMPLE = 256


def cut(scored: DataFrame, key: str, contamination: float) -> DataFrame:
    """Label the ``contamination`` share of rows with the highest scores."""
    limit = with_quantiles(scored, ["score"], (1 - contamination,))
    above = F.col("score") > F.col("_s.q_score")[0]
    return attach(scored, limit).select(key, "score", F.when(above, -1).otherwise(1).alias("label"))


def _points(df: DataFrame, key: str, columns: Sequence[str] | None) -> DataFrame:
    return arrays(scaled(df, columns, [key], fill="mean"), [key])


# --- isolation forest ---------------------------------------------------------------------


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Average path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, list]:
    """One tree as flat arrays: feature, threshold, left, right, path."""
    tree: dict[str, list] = {"f": [], "t": [], "l": [], "r": [], "p": []}

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(tree["f"])
        for name, v in zip("ftlrp", (-1, 0.0, -1, -1, depth + float(_mean_path(np.array([len(rows)]))[0]))):
            tree[name].append(v)
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        open_ = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_):
            return at
        f = int(rng.choice(open_))
        t = float(rng.uniform(low[f], high[f]))
        side = rows[:, f] < t
        tree["f"][at], tree["t"][at] = f, t
        tree["l"][at] = node(rows[side], depth + 1)
        tree["r"][at] = node(rows[~side], depth + 1)
        return at

    node(x, 0)
    return tree


def isolation_forest(df: DataFrame, key: str, columns: Sequence[str] | None = None, contamination: float = 0.1, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Trees grown in parallel, each from its own sample of the whole table, then one scoring pass.

    Every row draws a number for every tree; a tree takes the ``sample`` rows
    with the smallest numbers. Numbers above twice the expected cut never leave
    the scan, so about two samples a tree are shuffled however long the table is.
    """
    points = spread(_points(df, key, columns))
    n = points.count()
    share = 1.0 if n <= 2 * sample else 2.0 * sample / n
    below = F.lit(int(share * 2**62))
    number = lambda tree: F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(SEED), tree), 2)
    wanted = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: number(tree) < below)
    draw = Window.partitionBy("tree").orderBy("h")
    drawn = points.select(key, "x", F.explode(wanted).alias("tree")).withColumn("h", number(F.col("tree"))).withColumn("n", F.row_number().over(draw)).filter(F.col("n") <= sample)
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def build(key_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = matrix(rows.sort_values("n")["x"])
        return pd.DataFrame({"tree": [key_[0]], "size": [len(x)], "body": [json.dumps(_grow(x, np.random.default_rng(SEED + int(key_[0])), limit))]})

    grown = drawn.select("tree", "n", "x").groupBy("tree").applyInPandas(build, "tree int, size int, body string").collect()
    size = max(r["size"] for r in grown)
    forest = [{k: np.asarray(v) for k, v in json.loads(r["body"]).items()} for r in sorted(grown, key=lambda r: r["tree"])]
    shared = df.sparkSession.sparkContext.broadcast(forest)
    typical = float(_mean_path(np.array([size]))[0]) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        data = matrix(x)
        total = np.zeros(len(data))
        for tree in shared.value:
            at = np.zeros(len(data), dtype=int)
            for _ in range(limit):
                f = tree["f"][at]
                inner = f >= 0
                if not inner.any():
                    break
                left = data[np.arange(len(data)), np.maximum(f, 0)] < tree["t"][at]
                at = np.where(inner, np.where(left, tree["l"][at], tree["r"][at]), at)
            total += tree["p"][at]
        return pd.Series(2.0 ** (-(total / len(shared.value)) / typical))

    return cut(stage(points.select(key, score("x").alias("score"))), key, contamination)


# --- robust covariance -----------------------------------------------------------------------


def _local_ellipses(x: np.ndarray, share: float, starts: int, tries: int = 200) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centres and covariances of the best concentrated random starts on a sample."""
    rng, (n, d) = np.random.default_rng(SEED), x.shape
    held = min(n, max(d + 1, math.ceil(share * n)))

    def concentrated(mean: np.ndarray, cov: np.ndarray, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
        for _ in range(steps):
            diff = x - mean
            near = x[np.argsort(np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(cov, hermitian=True), diff), kind="stable")[:held]]
            mean, cov = near.mean(axis=0), np.cov(near.T, bias=True).reshape(d, d)
        return np.linalg.slogdet(cov)[1], mean, cov

    found = []
    for _ in range(tries if n > d + 1 else 0):
        few = x[rng.choice(n, d + 1, replace=False)]
        found.append(concentrated(few.mean(axis=0), np.cov(few.T, bias=True).reshape(d, d), 2))
    best = sorted(found, key=lambda f: f[0])[:starts]
    return [concentrated(mean, cov, 20)[1:] for _, mean, cov in best]


def robust_ellipse(points: DataFrame, d: int, starts: int = 10, steps: int = 30, sample: int = 600) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance and its log determinant of the half of staged ``points`` (x) that lies closest together.

    Starts come from a sample of ``sample`` rows by hash, and one is the ellipse
    of all rows. All of them concentrate together: one scan measures every row
    from every start, one exact quantile pass finds each start's closest half,
    and one sums their moments. A step never enlarges a determinant; after two of
    them the two best starts go on until nothing moves, beside the one of all rows.
    """
    n, mean, cov = covariance(points, d)
    share = min(1.0, max((n + d + 1) / 2 / n, 0.5))
    rows = matrix(pd.Series([r["x"] for r in points.select("x").orderBy(F.xxhash64("x"), "x").limit(sample).collect()]))
    now = [(mean, cov), *_local_ellipses(rows, share, starts)]
    last = [math.inf] * len(now)
    size = 1 + d + d * d
    for step in range(steps):
        inverses = [np.linalg.pinv(c, hermitian=True) for _, c in now]
        centres = [m for m, _ in now]

        @F.pandas_udf("array<double>")
        def far(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            data = matrix(x)
            return pd.Series(list(np.stack([np.einsum("ij,jk,ik->i", data - m, i, data - m) for m, i in zip(centres, inverses)], axis=1)))  # noqa: B023

        names = [f"d{k}" for k in range(len(now))]
        seen = stage(points.select("x", far("x").alias("far")).select("x", *[F.col("far")[k].alias(c) for k, c in enumerate(names)]))
        row = with_quantiles(seen, names, (share,)).first()
        limits = np.array([row[f"q_{c}"][0] for c in names])

        def moments(frame: pd.DataFrame) -> np.ndarray:
            data, out = matrix(frame["x"]), []
            for c, limit in zip(names, limits):  # noqa: B023
                own = data[frame[c].to_numpy() <= limit]
                out.append(np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()]))
            return np.concatenate(out)

        total = batch_sums(seen, moments, size * len(now)).reshape(len(now), size)
        now, found = [], []
        for sums in total:
            mean = sums[1 : 1 + d] / sums[0]
            cov = sums[1 + d :].reshape(d, d) / sums[0] - np.outer(mean, mean)
            now.append((mean, cov))
            found.append(float(np.linalg.slogdet(cov)[1]))
        if step == 1:
            keep = [0, *sorted(range(1, len(now)), key=lambda k: found[k])[:2]]
            now, found, last = [now[k] for k in keep], [found[k] for k in keep], [last[k] for k in keep]
        if all(not math.isfinite(f) or p - f < 1e-9 for p, f in zip(last, found)):
            break
        last = found
    best = min(range(len(now)), key=lambda k: found[k])
    return *now[best], found[best]


def _chi2_upper(tail: float, df: float) -> float:
    low, high = 0.0, df + 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_tail(df / 2, middle / 2) > tail else (low, middle)
    return low


def elliptic_envelope(df: DataFrame, key: str, columns: Sequence[str] | None = None, contamination: float = 0.1, steps: int = 30) -> DataFrame:
    """Mahalanobis distance from a centre and covariance that strange rows do not pull.

    The closest half by :func:`robust_ellipse`, widened so that its median
    distance is that of a normal distribution, tells which rows are regular (all
    but 2.5 % of a normal one); the ellipse of those rows measures all. With no
    ``steps`` it is the ellipse of all rows.
    """
    points = spread(_points(df, key, columns))
    d = width(points)

    def distances(mean: np.ndarray, cov: np.ndarray) -> DataFrame:
        inverse = np.linalg.pinv(cov, hermitian=True)

        @F.pandas_udf("double")
        def far(x: pd.Series) -> pd.Series:
            diff = matrix(x) - mean
            return pd.Series(np.einsum("ij,jk,ik->i", diff, inverse, diff))

        return points.select(key, "x", far("x").alias("score"))

    if steps:
        mean, cov, _ = robust_ellipse(points.select("x"), d, steps=steps)
        seen = stage(distances(mean, cov))
        middle = with_quantiles(seen.select("score"), ["score"], (0.5,)).first()["q_score"][0]
        widened = middle / _chi2_upper(0.5, d)
        regular = seen.filter(F.col("score") < _chi2_upper(0.025, d) * widened)
        if widened > 0:
            _, mean, cov = covariance(regular.select("x"), d)
    else:
        _, mean, cov = covariance(points, d)
    return cut(stage(distances(mean, cov).select(key, "score")), key, contamination)


# --- one-class boundary -----------------------------------------------------------------------


def one_class_svm(df: DataFrame, key: str, columns: Sequence[str] | None = None, nu: float = 0.1, features: int = 128, steps: int = 60) -> DataFrame:
    """RBF one-class boundary on random Fourier features, by full sub-gradient steps.

    Every step is one pass that sums a vector of ``features`` numbers.
    """
    points = spread(_points(df, key, columns))
    d = width(points)
    rng = np.random.default_rng(SEED)
    gamma = 1.0 / d
    freq = rng.normal(scale=np.sqrt(2 * gamma), size=(d, features))
    phase = rng.uniform(0, 2 * np.pi, size=features)

    def lift(x: np.ndarray) -> np.ndarray:
        return np.sqrt(2.0 / features) * np.cos(x @ freq + phase)

    total = batch_sums(points.select("x"), lambda f: np.concatenate([[len(f)], lift(matrix(f["x"])).sum(axis=0)]), 1 + features)
    n, w = total[0], total[1:] / total[0]
    rho = 0.0
    for step in range(1, steps + 1):
        w_now, rho_now = w, rho

        def gradient(frame: pd.DataFrame) -> np.ndarray:
            z = lift(matrix(frame["x"]))
            inside = z @ w_now < rho_now
            return np.concatenate([[inside.sum()], z[inside].sum(axis=0)])

        sums = batch_sums(points.select("x"), gradient, 1 + features)
        rate = 1.0 / step
        w = w - rate * (w - sums[1:] / (nu * n))
        rho = rho - rate * (sums[0] / (nu * n) - 1)
    weights = w

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(-(lift(matrix(x)) @ weights))

    return cut(stage(points.select(key, score("x").alias("score"))), key, nu)


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


def one_class_dual(kernel: np.ndarray, nu: float, tolerance: float = 1e-5) -> np.ndarray:
    """Weights that sum to 1, each at most 1 / (nu n), of the shortest combination of the rows.

    The pair that breaks the optimality conditions most moves weight from one to
    the other, until no pair breaks them by ``tolerance``.
    """
    n = len(kernel)
    most = 1.0 / max(nu * n, 1.0)
    weight = np.minimum(most, np.maximum(0.0, 1.0 - most * np.arange(n)))
    scores = kernel @ weight
    diagonal = np.diagonal(kernel)
    while True:
        up = int(np.argmin(np.where(weight < most, scores, np.inf)))
        down = int(np.argmax(np.where(weight > 0, scores, -np.inf)))
        if n < 2 or scores[down] - scores[up] < tolerance:
            return weight
        bend = max(diagonal[up] + diagonal[down] - 2 * kernel[up, down], 1e-12)
        # A weight that reaches a bound takes the bound's own value.
        move = min((scores[down] - scores[up]) / bend, most - weight[up], weight[down])
        weight[up] = most if move == most - weight[up] else weight[up] + move
        weight[down] = 0.0 if move == weight[down] else weight[down] - move
        scores += move * (kernel[up] - kernel[down])


def one_class_fit(points: DataFrame, d: int, nu: float = 0.1, error: float = 0.05, sample: int = 1024) -> tuple[np.ndarray, np.ndarray, float]:
    """Support rows, their weights, and the gap of the RBF one-class boundary over all staged ``points`` (x).

    The objective is half the boundary's squared length less the mean score of
    the ``nu`` share of rows with the lowest scores; its optimum is the dual's.
    The exact dual of rows drawn by hash gives a boundary, one pass measures the
    objective on all rows, and the draw doubles until objective and dual differ
    by no more than ``error`` times the dual. On average a draw's optimum is not
    above that of all rows, so this gap bounds what is left to gain; with
    ``sample`` or fewer rows it is the optimum. The size needed grows with
    1 / (nu error^2), not with the number of rows; its square is the memory.
    """
    gamma, n = 1.0 / d, points.count()
    drawn = min(sample, n)
    while True:
        rows = matrix(pd.Series([r["x"] for r in points.select("x").orderBy(F.xxhash64("x"), "x").limit(drawn).collect()]))
        kernel = rbf(rows, rows, gamma)
        weight = one_class_dual(kernel, nu)
        square = float(weight @ kernel @ weight)
        held, weight = rows[weight > 0], weight[weight > 0]
        if drawn >= n:
            return held, weight, 0.0
        scores = stage(points.select(_similarity(held, weight, gamma)("x").alias("score")))
        level = with_quantiles(scores, ["score"], (nu,)).first()["q_score"][0]
        below = scores.agg(F.avg(F.greatest(F.lit(level) - F.col("score"), F.lit(0.0)))).first()[0]
        gap = square - (level - below / nu)
        if gap <= error * square / 2:
            return held, weight, gap
        drawn = min(2 * drawn, n)


def _similarity(rows: np.ndarray, weight: np.ndarray, gamma: float):
    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(rbf(matrix(x), rows, gamma) @ weight if len(x) else np.zeros(0))

    return score


def one_class_boundary(df: DataFrame, key: str, columns: Sequence[str] | None = None, nu: float = 0.1, error: float = 0.05) -> DataFrame:
    """RBF one-class boundary within ``error`` of the optimum, by :func:`one_class_fit`; then one scoring pass.

    Unlike :func:`one_class_svm`, whose features and steps have no error bound
    and keep near a density, this is the support-vector boundary itself: a tight
    group of ``nu`` of all rows may lie inside it. Equal rows are drawn together by their hash; a row's score does not depend
    on its key or the partitions.
    """
    points = spread(_points(df, key, columns))
    d = width(points)
    rows, weight, _ = one_class_fit(points.select("x"), d, nu, error)
    return cut(stage(points.select(key, (-_similarity(rows, weight, 1.0 / d)("x")).alias("score"))), key, nu)


# --- neighbours, ensembles -----------------------------------------------------------------------


def local_outliers(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 20, contamination: float = 0.1) -> DataFrame:
    from tablewright.operators.neighbours import local_outlier_factor

    return cut(stage(local_outlier_factor(df, key, columns, k)), key, contamination)


def zscore(df: DataFrame, key: str, columns: Sequence[str] | None = None, threshold: float = 3.0) -> DataFrame:
    return row_zscore(df, key, columns, threshold)


DETECTORS = {
    "isolation_forest": isolation_forest,
    "lof": local_outliers,
    "one_class_svm": one_class_svm,
    "elliptic_envelope": elliptic_envelope,
    "zscore": zscore,
}


def ensemble(df: DataFrame, key: str, columns: Sequence[str] | None = None, methods: Sequence[str] = ("isolation_forest", "lof", "one_class_svm"), voting_threshold: float = 0.5) -> DataFrame:
    return vote({m: DETECTORS[m](df, key, columns) for m in methods}, key, voting_threshold)


def labels(df: DataFrame, key: str, columns: Sequence[str] | None = None, method: str = "ensemble") -> DataFrame:
    """Labels by a named method, the vote of three by default; the same one at every table size."""
    found = ensemble(df, key, columns) if method == "ensemble" else DETECTORS[method](df, key, columns)
    return found.select(key, "label")


def detect(df: DataFrame, key: str, method: str = "ensemble", columns: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels and their summary by method name."""
    if method == "ensemble":
        out = ensemble(df, key, columns)
        return out, vote_summary(out, 3)
    elif method in DETECTORS:
        out = DETECTORS[method](df, key, columns)
        return out, anomaly_stats(out)
    else:
        raise ValueError(f"unknown method: {method}")


def compare(df: DataFrame, key: str, columns: Sequence[str] | None = None, methods: Sequence[str] = tuple(DETECTORS)) -> DataFrame:
    columns = [c for c in numeric_columns(df, columns) if c != key]
    return compare_methods({m: DETECTORS[m](df, key, columns) for m in methods})
