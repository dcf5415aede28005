"""Trends that bend: planted breaks, and the optimum against a plain solver."""

import datetime

import numpy as np
import pytest

from tablewright.operators import breaks


def proximal(gram, free, penalty):
    """The same objective by accelerated gradient steps."""
    k = len(gram) - 1
    g, c = gram[:k, :k], gram[:k, k]
    step, b, z, t = 1 / np.linalg.eigvalsh(g)[-1], np.zeros(k), np.zeros(k), 1.0
    for _ in range(200_000):
        new = z - step * (g @ z - c)
        new[free:] = np.sign(new[free:]) * np.maximum(np.abs(new[free:]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, b = new + (last - 1) / t * (new - b), new
    return b


def objective(gram, free, penalty, b):
    k = len(gram) - 1
    return b @ gram[:k, :k] @ b / 2 - gram[:k, k] @ b + penalty * np.abs(b[free:]).sum()


@pytest.mark.parametrize("penalty", [0.0005, 0.01, 10.0])
def test_objective_equals_a_plain_solver(penalty):
    rng = np.random.default_rng(101)
    shape = breaks.Shape(weekly=2, yearly=0, breaks=8)
    day = np.arange(300.0)
    x = np.concatenate([shape.design(day, day / 299), (np.where(day < 120, day, 240 - day) / 50 + rng.normal(size=300) * 0.2)[:, None]], axis=1)
    gram = x.T @ x / 300
    b = breaks.few_bends(gram, shape.free, penalty)
    assert objective(gram, shape.free, penalty, b) == pytest.approx(objective(gram, shape.free, penalty, proximal(gram, shape.free, penalty)), rel=1e-7)
    assert penalty < 10 or not b[shape.free :].any()


def series(key, values, rng=None):
    first = datetime.datetime(2022, 1, 1)
    return [(key, first + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)]


def test_planted_breaks(spark):
    rng = np.random.default_rng(102)
    t = np.arange(500)
    bend = np.where(t < 160, 0.05 * t, 8 - 0.1 * (t - 160)) + np.sin(2 * np.pi * t / 7) + rng.normal(size=500) * 0.1
    rows = series("bends", bend) + series(None, 0.02 * t + rng.normal(size=500) * 0.1) + [("bends", None, 1.0), ("bends", datetime.datetime(2022, 1, 1), None)]
    s = spark.createDataFrame(rows, "k string, t timestamp, y double").repartition(3)
    shape = breaks.Shape(weekly=3, yearly=0)
    bends = breaks.break_points(s, ["k"], shape).collect()
    strong = [r for r in bends if abs(r.change) > 0.02]
    assert {r.k for r in strong} == {"bends"} and all(abs((r.date - datetime.date(2022, 1, 1)).days - 160) <= 20 for r in strong)
    assert sum(r.change for r in bends if r.k == "bends") == pytest.approx(-0.15, abs=0.01)
    ahead = {(r.k, r.step): r for r in breaks.forecast(s, 10, ["k"], shape).collect()}
    assert len(ahead) == 20 and ahead["bends", 1].n == 500
    want = 8 - 0.1 * (509 - 160) + np.sin(2 * np.pi * 509 / 7)
    assert abs(ahead["bends", 10].forecast - want) < 0.6 and ahead["bends", 10].date == datetime.date(2022, 1, 1) + datetime.timedelta(days=509)
    assert ahead[None, 10].forecast == pytest.approx(0.02 * 509, abs=0.3)
    assert {(r.k, r.n, r.violated) for r in breaks.optimality(s, ["k"], shape).collect()} == {("bends", 500, 0), (None, 500, 0)}


def test_odd_series(spark):
    schema = "k string, t timestamp, y double"
    assert breaks.forecast(spark.createDataFrame([], schema), 3, ["k"]).collect() == []
    one = spark.createDataFrame(series("a", [4.0]) + series("b", [3.0] * 40), schema)
    assert {r.k: round(r.forecast, 6) for r in breaks.forecast(one, 1, ["k"]).collect()} == {"a": 4.0, "b": 3.0}
    assert breaks.break_points(one, ["k"]).collect() == []
