"""Ward trees against a plain agglomeration over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import clustering, ward
from tablewright.operators.features import scaled
from tablewright.session import stage


def plain(x, w):
    """Costs of all merges and the clusters at every number of them, one merge at a time."""
    n, x, members = w.astype(float), x.copy(), [{i} for i in range(len(x))]
    d = (n[:, None] * n / (n[:, None] + n)) * ((x[:, None] - x) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    costs, cuts, alive = [], {}, np.ones(len(x), bool)
    for left in range(len(x), 1, -1):
        cuts[left] = [frozenset(m) for m, a in zip(members, alive) if a] if left <= 6 else None
        i, j = divmod(int(d.argmin()), len(x))
        costs.append(d[i, j])
        x[i] = (x[i] * n[i] + x[j] * n[j]) / (n[i] + n[j])
        n[i] += n[j]
        members[i] |= members[j]
        alive[j] = False
        d[j] = d[:, j] = np.inf
        row = n[i] * n / (n[i] + n) * ((x - x[i]) ** 2).sum(axis=1)
        row[~alive] = np.inf
        row[i] = np.inf
        d[i] = d[:, i] = row
    return costs, cuts


def points(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.integers(0, 4, (n, 1)) * 3
    return x, rng.integers(1, 5, n)


@pytest.mark.parametrize("n, d, finish, leaf", [(2000, 3, 2048, 4096), (160, 2, 40, 16)])
def test_merges(spark, n, d, finish, leaf):
    """In one task, and in rounds over many tiles."""
    x, w = points(n, d, 81)
    rows = stage(spark.createDataFrame([(i, int(w[i]), [float(v) for v in x[i]]) for i in range(n)], "id long, w long, x array<double>"))
    got = ward.merges(rows, finish, leaf).collect()
    costs, cuts = plain(x, w)
    np.testing.assert_allclose(sorted(r.cost for r in got), costs, rtol=1e-9)
    assert sum(r.size == w.sum() for r in got) == 1 and sorted(r.b for r in got) == sorted(set(range(n)) - {0})
    for k in (2, 5):
        parent = list(range(n))
        for r in sorted(got, key=lambda r: r.cost)[: n - k]:
            parent[r.b] = r.a
        root = lambda i: i if parent[i] == i else root(parent[i])
        groups = {}
        for i in range(n):
            groups.setdefault(root(i), set()).add(i)
        assert {frozenset(g) for g in groups.values()} == set(cuts[k])


def test_nearest_breaks_ties_alike():
    """On a grid, where most costs are equal: some pair is always mutual, and every cluster ends in one."""
    x = np.array([(i, j) for i in range(6) for j in range(6)], float)
    ids, one = np.random.default_rng(82).permutation(36), np.ones(36)
    merges = ward.agglomerate(ids, one, x)
    assert len(merges) == 35 and merges[-1][3] == 36 and merges[-1][0] == 0
    assert sum(c for _, _, c, _ in merges) == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())


def test_hierarchical_labels(spark):
    x, _ = points(90, 2, 83)
    x[40:50] = x[40]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    tree, done, metrics = clustering.hierarchical(scaled(df, ["a", "b"], ["id"]), 4)
    label = np.array([r.prediction for r in done.orderBy("id").collect()])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    unique, back, counts = np.unique(z, axis=0, return_inverse=True, return_counts=True)
    want = plain(unique, counts)[1][4]
    assert {frozenset(back.ravel()[label == c].tolist()) for c in range(4)} == set(want)
    inertia = sum(((z[label == c] - z[label == c].mean(axis=0)) ** 2).sum() for c in range(4))
    assert metrics["inertia"] == pytest.approx(inertia)
    for c in range(4):
        np.testing.assert_allclose(tree.clusterCenters()[c], z[label == c].mean(axis=0))
    again = clustering.cluster(df.repartition(3), "id", ["a", "b"], "hierarchical", 4).orderBy("id")
    assert [r.cluster for r in again.collect()] == label.tolist()


def test_one_point_and_none(spark):
    one = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0)], "id long, a double, b double")
    assert {r.cluster for r in clustering.cluster(one, "id", ["a", "b"], "hierarchical", 3).collect()} == {0}
    assert ward.merges(stage(one.limit(0).select("id", F.lit(1).cast("long").alias("w"), F.array("a", "b").alias("x")))).collect() == []


def test_tiles_merge_alone_as_far_as_they_can(spark):
    """Interiors of tiles need no rounds: one pass leaves few clusters, and the tree is the one of all pairs."""
    rng = np.random.default_rng(7)
    x, w = rng.uniform(size=(1500, 2)), rng.integers(1, 4, 1500)
    rows = stage(spark.createDataFrame([(i, int(w[i]), [float(v) for v in x[i]]) for i in range(1500)], "id long, w long, x array<double>"))
    done, left = ward._within_tiles(rows, 2, 256)
    done, left = done.collect(), left.collect()
    assert len(left) < 0.5 * len(x) and len(done) + len(left) == len(x)
    whole = {(a, b): (c, s) for a, b, c, s in ward.agglomerate(np.arange(1500), w, x)}
    for r in done:
        cost, size = whole[r.a, r.b]
        assert size == r["size"] and abs(cost - r.cost) < 1e-9
    assert sum(r.w for r in left) == w.sum()
    costs = sorted(r.cost for r in ward.merges(rows, 100, 64).collect())
    np.testing.assert_allclose(costs, sorted(c for c, _ in whole.values()), rtol=1e-9)
