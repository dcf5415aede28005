"""Ward's agglomeration without the table of all pairs, by rounds of reciprocal neighbours.

Two clusters that are each other's nearest under Ward's cost are merged in
Ward's tree sooner or later, whatever else merges meanwhile: the cost of no
other merge can fall below theirs. So each round merges all such pairs at once,
and a cluster is its centre and size. First every tile merges on its own as long
as the boxes and least sizes of the others say that nobody elsewhere is nearer.
Where that leaves most clusters (boxes of many columns overlap), neighbours are
looked for tile by tile; a tile is visited only if box distance and least sizes
allow a lower cost than what the own tile has. When few clusters are left, one
task finishes the tree.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.tiles import LEAF, Boxes, box_pairs, boxes, compare, rows_of, tiled
from tablewright.session import stage

#: Clusters that one task brings to the end, and tiles whose boxes every task may see.
FINISH, SHOWN = 8192, 20_000

_MERGE = "a long, b long, cost double, size long"
_COLUMNS = {"a": pa.int64(), "b": pa.int64(), "cost": pa.float64(), "size": pa.int64()}
_NEXT = "id long, other long, cost double"


def nearest(ids: np.ndarray, n: np.ndarray, x: np.ndarray, others: np.ndarray, m: np.ndarray, y: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """For each cluster (ids, sizes n, centres x) the other one that costs least to merge with, and the cost.

    Of equal costs the pair with the least ids goes first, in the same order
    from either side. -1 where there is no other.
    """
    best, cost = np.full(len(ids), -1, np.int64), np.full(len(ids), np.inf)
    if not len(others):
        return best, cost
    middle = y.mean(axis=0)
    u, v = x - middle, y - middle
    b = (v * v).sum(axis=1)
    for lo in range(0, len(ids), block):
        own = slice(lo, lo + block)
        a = (u[own] ** 2).sum(axis=1)[:, None]
        share = n[own, None] * m / (n[own, None] + m)
        loose = 1e-12 * share * (a + b)
        near = share * (a + b - 2 * u[own] @ v.T)
        near[ids[own, None] == others] = np.inf
        # Products tell who may be least; the differences of those decide.
        i, j = np.nonzero(near - loose <= (near + loose).min(axis=1)[:, None])
        fine = np.isfinite(near[i, j])
        i, j = i[fine], j[fine]
        exact = n[lo + i] * m[j] / (n[lo + i] + m[j]) * ((x[lo + i] - y[j]) ** 2).sum(axis=1)
        low, high = np.minimum(ids[lo + i], others[j]), np.maximum(ids[lo + i], others[j])
        order = np.lexsort((high, low, exact, i))
        first = order[np.unique(i[order], return_index=True)[1]]
        best[lo + i[first]], cost[lo + i[first]] = others[j[first]], exact[first]
    return best, cost


def _merged(
    ids: np.ndarray, n: np.ndarray, x: np.ndarray, least_outside: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> tuple[list[tuple[int, int, float, int]], np.ndarray, np.ndarray, np.ndarray]:
    """All merges (a, b, cost, size) among some clusters that no cluster elsewhere can forestall, and the clusters (ids, n, x) that are left.

    ``least_outside(n, x)`` is below what any merge with a cluster elsewhere
    costs. No merge brings a cluster nearer to a third one than the nearer of
    its two parts was, so only clusters that lost their nearest one look again.
    """
    order = np.argsort(ids)
    ids, n, x = ids[order], n[order].astype(float), x[order].astype(float)
    (other, cost), bound = nearest(ids, n, x, ids, n, x), least_outside(n, x)
    merges = []
    while len(ids) > 1:
        at = np.searchsorted(ids, other)
        sure = (other >= 0) & (cost < bound * (1 - 1e-9))
        at[~sure] = 0
        one = np.flatnonzero(sure & sure[at] & (other[at] == ids) & (ids < other))
        if not len(one):
            break
        two = at[one]
        merges += [(int(ids[i]), int(ids[j]), float(cost[i]), int(n[i] + n[j])) for i, j in zip(one, two)]
        stale = np.isin(other, ids[np.concatenate([one, two])])
        x[one] = (x[one] * n[one, None] + x[two] * n[two, None]) / (n[one] + n[two])[:, None]
        n[one] += n[two]
        bound[one] = least_outside(n[one], x[one])
        left = np.ones(len(ids), bool)
        left[two] = False
        ids, n, x, other, cost, bound, stale = (v[left] for v in (ids, n, x, other, cost, bound, stale))
        other[stale], cost[stale] = nearest(ids[stale], n[stale], x[stale], ids, n, x)
    return merges, ids, n, x


def agglomerate(ids: np.ndarray, n: np.ndarray, x: np.ndarray) -> list[tuple[int, int, float, int]]:
    """All merges (a, b, cost, size) of some clusters; a merged cluster goes by its least id, a."""
    return _merged(ids, n, x, lambda n, x: np.full(len(n), np.inf))[0]


def _least_outside(own: int, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, near: int = 64):
    """What clusters of box ``own`` must pay at least to merge with one of another box, whose sizes start at ``least``.

    The ``near`` boxes are measured from each cluster, the others from the own
    box. Merging keeps centres in their box and only adds to sizes, so the
    bound holds while all boxes merge at once.
    """
    gap = (np.maximum(0, np.maximum(lo[own] - hi, lo - hi[own])) ** 2).sum(axis=1)
    gap[own] = np.inf
    order = np.argsort(gap, kind="stable")[: len(gap) - 1]
    close, far = order[:near], order[near:]

    def bound(n: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.full(len(n), np.inf)
        for q in close:
            out = np.minimum(out, n * least[q] / (n + least[q]) * (np.maximum(0, np.maximum(lo[q] - x, x - hi[q])) ** 2).sum(axis=1))
        if len(far):
            m = least[far].min()
            out = np.minimum(out, n * m / (n + m) * gap[far[0]])
        return out

    return bound


def _within_tiles(clusters: DataFrame, width: int, leaf: int) -> tuple[DataFrame, DataFrame] | None:
    """Merges that tiles can tell on their own, and the clusters that are left; none where there are too many tiles to show to each."""
    tiles = tiled(clusters, width, leaf)
    # One row a tile.
    around = boxes(tiles).join(tiles.groupBy("tile").agg(F.min("w").alias("least")), "tile").select("tile", "lo", "hi", "least").limit(SHOWN + 1).toArrow()
    if around.num_rows > SHOWN:
        return None
    spark = clusters.sparkSession
    shared = spark.sparkContext.broadcast((around.column("tile").to_numpy(), rows_of(around.column("lo")), rows_of(around.column("hi")), around.column("least").to_numpy().astype(float)))

    def merge(table: pa.Table) -> pa.Table:
        names, lo, hi, least = shared.value
        own = int(np.flatnonzero(names == table.column("tile")[0].as_py())[0])
        done, ids, n, x = _merged(table.column("id").to_numpy(), table.column("w").to_numpy(), rows_of(table.column("x")), _least_outside(own, lo, hi, least))
        none, k = [None] * len(done), len(ids)
        return pa.table(
            {
                "id": pa.array([*none, *ids.tolist()], pa.int64()),
                "w": pa.array([*none, *n.astype(np.int64).tolist()], pa.int64()),
                "x": pa.array([*none, *x.tolist()], pa.list_(pa.float64())),
                **{c: pa.array([*(r[i] for r in done), *[None] * k], t) for i, (c, t) in enumerate(_COLUMNS.items())},
            }
        )

    out = stage(tiles.groupBy("tile").applyInArrow(merge, f"id long, w long, x array<double>, {_MERGE}"))
    return out.filter("id is null").select(*_COLUMNS), out.filter("id is not null").select("id", "w", "x")


def _own(left: pa.Table) -> pa.Table:
    ids, n, x = left.column("id").to_numpy(), left.column("w").to_numpy().astype(float), rows_of(left.column("x"))
    other, cost = nearest(ids, n, x, ids, n, x)
    return pa.table({"tile": left.column("tile"), "id": ids, "other": other, "cost": cost, "w": left.column("w")})


def _cheaper(p: Boxes, q: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Other tiles in which some cluster of a tile may find a cheaper merge than in its own."""
    limit, small, less = p.table.column("limit").to_numpy(), p.table.column("least").to_numpy(), q.table.column("least").to_numpy()
    found = []
    for i in range(len(p.tile)):
        bound = small[i] * less / (small[i] + less) * p.gaps(i, q).sum(axis=1)
        found.append(np.flatnonzero((bound <= limit[i] * (1 + 1e-9)) & (q.tile != p.tile[i])))
    return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)


def _across(left: pa.Table, right: pa.Table) -> pa.Table:
    n, m = (t.column("w").to_numpy().astype(float) for t in (left, right))
    ids = left.column("id").to_numpy()
    other, cost = nearest(ids, n, rows_of(left.column("x")), right.column("id").to_numpy(), m, rows_of(right.column("x")))
    return pa.table({"id": ids, "other": other, "cost": cost})


def _neighbours(clusters: DataFrame, width: int, leaf: int) -> DataFrame:
    """``(id, other, cost)``: the cheapest merge of every cluster."""
    tiles = tiled(clusters, width, leaf)
    own = stage(tiles.groupBy("tile").applyInArrow(_own, f"tile long, {_NEXT}, w long"))
    around = boxes(tiles).join(own.groupBy("tile").agg(F.max("cost").alias("limit"), F.min("w").cast("double").alias("least")), "tile")
    around = stage(around)
    n = around.count()
    rest = box_pairs(around, around, (n, n), _cheaper)
    found = own.select("id", "other", "cost").unionByName(compare(tiles, tiles, rest, _across, _NEXT)).filter("other >= 0")
    best = F.min(F.struct("cost", F.least("id", "other").alias("low"), F.greatest("id", "other").alias("high"), "other"))
    return found.groupBy("id").agg(best.alias("s")).select("id", "s.other", "s.cost")


def merges(points: DataFrame, finish: int = FINISH, leaf: int = LEAF) -> DataFrame:
    """``(a, b, cost, size)``: all merges of the Ward tree over staged ``points`` (id, w, x), one less than points.

    A cluster goes by the least id in it; ``cost`` is what the merge adds to the
    squared distances to centres, so ``sqrt(2 * cost)`` is the height. Clusters
    over ``finish`` merge in distributed rounds, the rest in one task.
    """
    clusters, done = points.select("id", "w", "x"), []
    first = points.select(F.size("x")).first()
    n = points.count()
    alone = True
    while n > finish:
        found = _within_tiles(clusters, first[0], leaf) if alone else None
        if found:
            before, (rows, clusters) = n, found
            done.append(rows)
            n = clusters.count()
            # Tiles that could do little on their own will do less with larger clusters.
            alone = n < 0.9 * before
            if n < 0.6 * before or n <= finish:
                continue
        near = stage(_neighbours(clusters, first[0], leaf))
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = near.join(back, ["id", "other"]).filter("id < other")  # each other's nearest
        joined = pairs.join(clusters, "id").join(clusters.select(F.col("id").alias("other"), F.col("w").alias("m"), F.col("x").alias("y")), "other")
        centre = F.zip_with("x", "y", lambda p, q: (p * F.col("w") + q * F.col("m")) / F.col("size"))
        joined = joined.withColumn("size", F.col("w") + F.col("m")).withColumn("centre", centre)
        joined = stage(joined.select("id", "other", "cost", F.col("size").alias("w"), F.col("centre").alias("x")))
        done.append(joined.select(F.col("id").alias("a"), F.col("other").alias("b"), "cost", F.col("w").alias("size")))
        gone = joined.select("id").unionByName(joined.select(F.col("other").alias("id")))
        clusters = stage(clusters.join(gone, "id", "left_anti").unionByName(joined.select("id", "w", "x")))
        n -= joined.count()

    def end(table: pa.Table) -> pa.Table:
        rows = agglomerate(table.column("id").to_numpy(), table.column("w").to_numpy(), rows_of(table.column("x")))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(_COLUMNS.items())})

    # At most ``finish`` clusters.
    out = clusters.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(end, _MERGE)
    for rows in done:
        out = out.unionByName(rows)
    return stage(out)
