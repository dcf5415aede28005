"""Daily series with a bending trend: waves, hinges, and a penalty that keeps few of them.

The trend is a line with a hinge at evenly spaced candidate breaks. Slopes of
hinges are charged by their size, so most are exactly zero and the others mark
where the trend changes. All that the fit needs of a series is its Gram matrix,
which adds up over rows in any order; the rest is coordinate descent on a few
dozen numbers a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.columns import quoted
from tablewright.session import join_groups, stage

#: Series whose matrices a task holds before it hands them on.
HELD = 2000


@dataclass(frozen=True)
class Shape:
    """Waves of a week and a year, candidate breaks in the first ``share`` of the time, and the price of a bend.

    ``penalty`` is charged per slope (in deviations of y over the whole time).
    """

    weekly: int = 3
    yearly: int = 3
    breaks: int = 25
    share: float = 0.8
    penalty: float = 0.001

    @property
    def free(self) -> int:
        return 2 + 2 * (self.weekly + self.yearly)

    def at(self) -> np.ndarray:
        return self.share * np.arange(1, self.breaks + 1) / max(1, self.breaks)

    def design(self, day: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One, place in time, waves, and hinges, in columns."""
        waves = [f(2 * math.pi * i / length * day) for length, most in ((7.0, self.weekly), (365.25, self.yearly)) for i in range(1, most + 1) for f in (np.sin, np.cos)]
        return np.stack([np.ones(len(day)), u, *waves, *[np.maximum(0, u - c) for c in self.at()]], axis=1)


def few_bends(gram: np.ndarray, free: int, penalty: float, floor: float = 0.0, sweeps: int = 20_000) -> np.ndarray:
    """Minimises b'Gb/2 - g'b + penalty * sum |b_j|, j from ``free`` on; ``gram`` has G and, last, g.

    Directions whose squares are at most ``floor`` say nothing and stay at zero.

    The free coefficients are solved for and put aside; of the others each is
    set in turn to its best. Once the signs hold, the system they give is solved
    as it stands.
    """
    k = len(gram) - 1
    g, target = gram[:k, :k], gram[:k, k]
    values, axes = np.linalg.eigh(g[:free, :free])
    sure = values > max(floor, 1e-13 * values.max(initial=0))
    inverse = (axes[:, sure] / values[sure]) @ axes[:, sure].T
    cross = inverse @ g[:free, free:]
    a, c = g[free:, free:] - g[free:, :free] @ cross, target[free:] - cross.T @ target[:free]
    b, size = np.zeros(k - free), np.diag(a)
    usable = np.flatnonzero(size > max(floor, 1e-12 * np.diag(g)[free:].max(initial=0)))

    def settled(x: np.ndarray) -> bool:
        slope = c - a @ x
        near = 1e-9 * max(penalty, np.abs(c).max(initial=0))
        return bool(np.all(np.where(x[usable] != 0, np.abs(slope[usable] - penalty * np.sign(x[usable])), np.abs(slope[usable]) - penalty) <= near))

    for sweep in range(sweeps):
        for j in usable:
            slope = c[j] - a[j] @ b + size[j] * b[j]
            b[j] = math.copysign(max(abs(slope) - penalty, 0.0), slope) / size[j]
        if sweep % 10 == 9:
            on = np.flatnonzero(b)
            exact = np.zeros_like(b)
            exact[on] = np.linalg.lstsq(a[np.ix_(on, on)], c[on] - penalty * np.sign(b[on]), rcond=None)[0]
            if (np.sign(exact) == np.sign(b)).all() and settled(exact):
                b = exact
                break
    return np.concatenate([inverse @ target[:free] - cross @ b, b])


def _placed(s: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the series' name ``s``, ``day`` and place in time ``u`` (0 to 1)."""
    name: Column = F.to_json(F.struct(*[quoted(b) for b in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    day = F.date_diff(F.col("t").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    rows = s.withColumns({"s": name, "day": day}).filter("day IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)")
    bounds = rows.groupBy("s").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return stage(join_groups(rows, bounds, ["s"]).withColumn("u", F.coalesce(F.try_divide(F.col("day") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))))


def fit(placed: DataFrame, shape: Shape) -> DataFrame:
    """``(s, n, beta, charge)`` of every series; ``charge`` is what a slope of a hinge costs."""
    k = shape.free + shape.breaks + 1

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"s": list(held), "v": [m.ravel().tolist() for m in held.values()]})

        for frame in frames:
            for name, own in frame.groupby("s", sort=False):
                x = np.concatenate([shape.design(own["day"].to_numpy(), own["u"].to_numpy()), own[["y"]].to_numpy(float)], axis=1)
                held[name] = held.get(name, 0) + x.T @ x
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = placed.select("s", "day", "u", "y").mapInPandas(grams, "s string, v array<double>")
    cells = parts.select("s", F.posexplode("v").alias("i", "x")).groupBy("s", "i").agg(F.sum("x").alias("x"))
    whole = cells.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("v"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, flat in zip(frame["s"], frame["v"]):
                gram = np.asarray(flat, float).reshape(k, k)
                n, means = gram[0, 0], gram[0] / gram[0, 0]
                around = (gram / n - np.outer(means, means))[1:, 1:]  # the level is what the rest leaves
                if around[-1, -1] <= 1e-13 * gram[-1, -1] / n:  # y does not vary beyond rounding
                    around[:] = 0
                charge = shape.penalty * math.sqrt(max(0.0, around[-1, -1]))
                slopes = few_bends(around, shape.free - 1, charge, floor=1e-11)
                rows.append((name, int(n), [means[-1] - means[1:-1] @ slopes, *slopes], charge))
            if rows:
                yield pd.DataFrame(rows, columns=["s", "n", "beta", "charge"])

    return stage(whole.mapInPandas(solve, "s string, n long, beta array<double>, charge double"))


def _values(shape: Shape):
    def value(beta: pd.Series, day: pd.Series, u: pd.Series) -> pd.Series:
        if not len(beta):
            return pd.Series([], dtype=float)
        return pd.Series((shape.design(day.to_numpy(float), u.to_numpy(float)) * np.stack(beta.to_numpy())).sum(axis=1))

    return F.pandas_udf(value, "double")


def forecast(s: DataFrame, steps: int = 30, by: Sequence[str] = (), shape: Shape = Shape()) -> DataFrame:
    """``(by..., n, mae, rmse, mape, step, date, forecast)``: errors of the fit, and the days after the last one.

    Null times and values are left out; a series with one day has no trend. The
    last slope goes on.
    """
    placed = _placed(s, by)
    model = fit(placed, shape)
    value = _values(shape)
    fitted = join_groups(placed, model, ["s"]).withColumn("miss", F.col("y") - value("beta", "day", "u"))
    errors = fitted.groupBy(*by, "s").agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.avg(F.abs("miss")).alias("mae"), F.sqrt(F.avg(F.col("miss") * F.col("miss"))).alias("rmse"),
        (F.avg(F.abs(F.try_divide("miss", "y"))) * 100).alias("mape"),
    )
    ahead = errors.join(model.select("s", "beta"), "s").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    ahead = ahead.withColumn("day", F.col("hi") + F.col("step"))
    u = F.coalesce(F.try_divide(F.col("day") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")).alias("date")
    return ahead.withColumn("u", u).select(*by, "n", "mae", "rmse", "mape", "step", date, value("beta", "day", "u").alias("forecast"))


def break_points(s: DataFrame, by: Sequence[str] = (), shape: Shape = Shape()) -> DataFrame:
    """``(by..., date, change)``: where the trend of a series bends, and by how much a day."""
    placed = _placed(s, by)
    bounds = placed.groupBy(*by, "s").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    bends = fit(placed, shape).select("s", F.posexplode(F.slice("beta", shape.free + 1, shape.breaks)).alias("j", "slope")).filter("slope <> 0")
    day = F.col("lo") + F.element_at(F.lit(shape.at().tolist()), F.col("j") + 1) * (F.col("hi") - F.col("lo"))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(day).cast("int")).alias("date")
    return bounds.join(bends, "s").select(*by, date, (F.col("slope") / (F.col("hi") - F.col("lo"))).alias("change"))


def optimality(s: DataFrame, by: Sequence[str] = (), shape: Shape = Shape()) -> DataFrame:
    """``(by..., n, violated)``: conditions of the optimum that the residuals of a series do not meet, counted from its rows.

    Free columns must not go with the residuals; a hinge in use must go with
    them by exactly its charge, one not in use by no more.
    """
    placed = _placed(s, by)
    model = fit(placed, shape)

    def products(day: pd.Series, u: pd.Series, y: pd.Series, beta: pd.Series) -> pd.Series:
        if not len(day):
            return pd.Series([], dtype=object)
        x = shape.design(day.to_numpy(float), u.to_numpy(float))
        return pd.Series(list(x * (y.to_numpy(float) - (x * np.stack(beta.to_numpy())).sum(axis=1))[:, None]))

    rows = join_groups(placed, model, ["s"]).withColumn("g", F.pandas_udf(products, "array<double>")("day", "u", "y", "beta"))
    slopes = rows.select(*by, "s", "n", "beta", "charge", F.posexplode("g").alias("j", "x")).groupBy(*by, "s", "n", "j").agg(
        F.avg("x").alias("x"), F.first(F.element_at("beta", F.col("j") + 1)).alias("b"), F.first("charge").alias("charge")
    )
    off = F.when(F.col("j") < shape.free, F.abs("x")).when(F.col("b") == 0, F.abs("x") - F.col("charge")).otherwise(F.abs(F.col("x") - F.col("charge") * F.signum("b")))
    worst = F.col("charge") / max(shape.penalty, 1e-12)
    return slopes.groupBy(*by, "n").agg(F.count_if(off > 1e-6 * worst).alias("violated"))
