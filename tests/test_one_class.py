"""The one-class boundary against the exact dual over all rows."""

import numpy as np
import pytest

from tablewright.operators import anomaly


def blobs(n, d, seed=5):
    rng = np.random.default_rng(seed)
    return np.r_[rng.normal(size=(n - n // 10, d)), rng.normal(3, 0.7, size=(n // 10, d))]


def objective(w, rows, x, nu, gamma):
    """Primal value of the boundary sum(w k(rows, .)) over all x, at its best offset."""
    low = np.sort(anomaly.rbf(x, rows, gamma) @ w)[: round(nu * len(x))]
    return 0.5 * w @ anomaly.rbf(rows, rows, gamma) @ w - low.mean()


@pytest.mark.parametrize("nu", [0.05, 0.1, 0.5])
def test_dual_meets_the_optimality_conditions(nu):
    x = blobs(300, 3)
    k = anomaly.rbf(x, x, 1 / 3)
    w = anomaly.one_class_dual(k, nu)
    most, scores = 1 / (nu * len(x)), k @ w
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w.max() <= most + 1e-12
    free = scores[(w > 0) & (w < most)]
    offset = free.mean() if len(free) else scores[w > 0].max()
    assert (scores[w == 0] >= offset - 1e-4).all() and (scores[w >= most] <= offset + 1e-4).all()
    # Strong duality: the primal at these weights is minus half the squared length.
    assert objective(w, x, x, nu, 1 / 3) == pytest.approx(-0.5 * w @ scores, abs=1e-4)


@pytest.mark.parametrize("d, error", [(2, 0.05), (8, 0.3)])
def test_gap_to_the_optimum_of_all_rows(spark, d, error):
    x = blobs(2000, d)
    points = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(5)
    rows, w, gap = anomaly.one_class_fit(points, d, 0.1, error, sample=64)
    assert len(rows) < len(x) and gap > 0
    full = anomaly.one_class_dual(anomaly.rbf(x, x, 1 / d), 0.1)
    best = -0.5 * full @ anomaly.rbf(x, x, 1 / d) @ full
    left = objective(w, rows, x, 0.1, 1 / d) - best
    assert -1e-4 <= left <= error * -best
    assert gap == pytest.approx(objective(w, rows, x, 0.1, 1 / d) + 0.5 * w @ anomaly.rbf(rows, rows, 1 / d) @ w, abs=1e-3)


def test_labels_do_not_follow_partitions(spark):
    x = blobs(400, 3)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    one, many = (anomaly.one_class_boundary(df.repartition(p), "id").toPandas().sort_values("id") for p in (1, 7))
    np.testing.assert_allclose(one["score"], many["score"], atol=1e-4)
    assert abs((one["label"] == -1).sum() - 40) <= 1


def test_equal_rows(spark):
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(20)], "id long, a double, b double")
    assert anomaly.one_class_boundary(same, "id").count() == 20
