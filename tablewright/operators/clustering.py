"""Clustering: k-means, Ward, mixtures and density, with their metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.features import arrays, scaled
from tablewright.operators.tiles import LEAF, Boxes, box_pairs, boxes, compare, joined, rows_of, tiled, tiled_against, within
from tablewright.operators.ward import FINISH, merges
from tablewright.session import beside, join_groups, scalars, spread, stage, together

SEED = 42


def _silhouette(done: DataFrame) -> float | None:
    if done.select("prediction").distinct().limit(2).count() < 2:
        return None
    return float(ClusteringEvaluator(featuresCol="features", predictionCol="prediction").evaluate(done))


class KMeansCentres:
    """Centres of k-means and the pass that gives each row the nearest."""

    def __init__(self, found: np.ndarray) -> None:
        self.found = found

    def clusterCenters(self) -> list[np.ndarray]:
        return list(self.found)

    def transform(self, features: DataFrame) -> DataFrame:
        """``features`` with ``prediction``; of equally near centres the first."""
        far = [F.aggregate(F.zip_with("_x", F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for c in self.found]
        first = F.array_position(F.array(*far), F.least(*far) if len(far) > 1 else far[0])
        return features.withColumn("_x", vector_to_array("features")).withColumn("prediction", (first - 1).cast("int")).drop("_x")


def _blocks(features: DataFrame, rows: int = 4096) -> DataFrame:
    """The vectors as the bytes of matrices of up to ``rows`` rows: every pass of k-means reads them again."""

    def pack(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                yield pa.RecordBatch.from_pydict({"n": pa.array([part.num_rows]), "x": pa.array([rows_of(part.column(0)).tobytes()], pa.binary())})

    return stage(features.select(vector_to_array("features").alias("x")).mapInArrow(pack, "n long, x binary"))


def _lloyd_sums(blocks: DataFrame, held: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One pass for several sets of centres: per set the rows that each centre is nearest to, their sums, and the squared distances."""
    every, d = np.concatenate(held), held[0].shape[1]
    ends = np.cumsum([len(c) for c in held])
    norms = (every**2).sum(axis=1)

    def add(batches):
        n, total, cost = np.zeros(len(every)), np.zeros((len(every), d)), np.zeros(len(held))
        for batch in batches:
            for size, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(raw.as_buffer(), float).reshape(size, d)
                far, own = norms - 2 * (x @ every.T), (x**2).sum(axis=1)
                for s, (c, end) in enumerate(zip(held, ends)):
                    mine = far[:, end - len(c) : end]
                    at = mine.argmin(axis=1)
                    cost[s] += np.maximum(mine[np.arange(size), at] + own, 0).sum()
                    member = (at[:, None] == np.arange(len(c))).astype(float)
                    n[end - len(c) : end] += member.sum(axis=0)
                    total[end - len(c) : end] += member.T @ x
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(out := np.concatenate([n, total.ravel(), cost])))), "v": pa.array(out)})

    rows = blocks.mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(every) * (1 + d) + len(held))
    for r in rows:
        out[r["i"]] = r["v"]
    n, total, cost = np.split(out, [len(every), len(every) * (1 + d)])
    total = total.reshape(-1, d)
    return [(n[end - len(c) : end], total[end - len(c) : end], float(cost[s])) for s, (c, end) in enumerate(zip(held, ends))]


def kmeans_fits(features: DataFrame, ks: Sequence[int], max_iter: int = 300, starts: int = 10, tolerance: float = 1e-4) -> dict[int, tuple[np.ndarray, float]]:
    """Centres and inertia of the best of ``starts`` k-means fits for every k, on staged ``features``.

    The starts are those of k-means|| with their seeds. All fits step together:
    one pass measures each row against the centres of all that still move by
    more than ``tolerance``, so the passes are those of the slowest fit. The
    inertia is that of the last pass, to the centres before their last step.
    """
    held = features.persist()

    def begin(k: int, i: int) -> tuple[int, np.ndarray]:
        return k, np.array(KMeans(featuresCol="features", k=k, seed=SEED + i, maxIter=0).fit(held).clusterCenters())

    try:
        begun = together(features.sparkSession, [partial(begin, k, i) for k in ks for i in range(starts)])
    finally:
        held.unpersist()
    blocks = _blocks(features)
    now, cost, moving = [c for _, c in begun], [0.0] * len(begun), list(range(len(begun)))
    for _ in range(max_iter):
        still = []
        for s, (n, total, inertia) in zip(moving, _lloyd_sums(blocks, [now[s] for s in moving])):
            # A centre without rows stays where it is.
            after = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now[s])
            if (((after - now[s]) ** 2).sum(axis=1) > tolerance**2).any():
                still.append(s)
            now[s], cost[s] = after, inertia
        if not (moving := still):
            break
    best = {k: min((s for s, (own, _) in enumerate(begun) if own == k), key=lambda s: cost[s]) for k in ks}
    return {k: (now[s], cost[s]) for k, s in best.items()}


def _kmeans_done(features: DataFrame, k: int, found: np.ndarray, inertia: float):
    model = KMeansCentres(found)
    done = model.transform(features)
    return model, done, {"k": k, "inertia": inertia, "silhouette": _silhouette(done)}


def kmeans(features: DataFrame, k: int = 3, max_iter: int = 300, starts: int = 10):
    """Model, labelled rows and metrics of the best of ``starts`` k-means fits on scaled ``features``."""
    features = spread(features)
    return _kmeans_done(features, k, *kmeans_fits(features, [k], max_iter, starts)[k])


class WardTree:
    """The merges of a Ward tree over different points, and flat clusters from it."""

    def __init__(self, features: DataFrame, finish: int = FINISH, leaf: int = LEAF) -> None:
        x = vector_to_array("features").alias("x")
        self.points = stage(features.groupBy(x).agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id()))
        self.merges = merges(self.points, finish, leaf)
        self.centres: list[np.ndarray] = []

    def cut(self, k: int) -> tuple[DataFrame, float]:
        """``(x, prediction)`` for ``k`` clusters (fewer if there are fewer points), numbered by their first point; and their inertia."""
        kept = self.merges
        for r in kept.orderBy(F.desc("cost"), F.desc("size"), "a").limit(k - 1).collect():
            kept = kept.filter(~((F.col("a") == r["a"]) & (F.col("b") == r["b"])))
        groups = components(kept.select(F.col("a").alias("u"), F.col("b").alias("v")), self.points.select(F.col("id").alias("node")))
        held = self.points.join(groups, F.col("id") == F.col("node"))
        # k rows: the first point of each cluster, and its centre.
        first = held.groupBy("component").agg(F.min("x").alias("first"))
        names = {r["component"]: i for i, r in enumerate(first.orderBy("first").collect())}
        number = F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.col("component"))
        done = stage(held.select("x", "w", number.cast("int").alias("prediction")))
        sums = done.select("prediction", "w", F.posexplode("x").alias("i", "v")).groupBy("prediction", "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"))
        self.centres = [np.zeros(0) for _ in names]
        for r in sums.groupBy("prediction").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c")).collect():
            self.centres[r["prediction"]] = np.array(r["c"])
        return done.select("x", "prediction"), kept.agg(F.coalesce(F.sum("cost"), F.lit(0.0))).first()[0]

    def clusterCenters(self) -> list[np.ndarray]:
        return self.centres


def hierarchical(features: DataFrame, k: int = 3, finish: int = FINISH, leaf: int = LEAF):
    """Ward's tree over scaled ``features`` cut at ``k`` clusters; equal rows are one weighted point."""
    features = stage(features)
    tree = WardTree(features, finish, leaf)
    labels, inertia = tree.cut(k)
    done = features.withColumn("_x", vector_to_array("features")).join(labels.withColumnRenamed("x", "_x"), "_x").drop("_x")
    return tree, done, {"k": k, "inertia": float(inertia), "silhouette": _silhouette(done)}


def mixture(features: DataFrame, k: int = 3, max_iter: int = 100):
    """Gaussian mixture with AIC and BIC from its log-likelihood."""
    model = GaussianMixture(featuresCol="features", k=k, seed=SEED, maxIter=max_iter).fit(features)
    done = model.transform(features)
    d = len(model.weights) and model.gaussians[0].mean.size
    free = k * (d + d * (d + 1) / 2 + 1) - 1
    like = float(model.summary.logLikelihood)
    n = done.count()
    return model, done, {
        "k": k, "aic": 2 * free - 2 * like, "bic": free * math.log(n) - 2 * like, "log_likelihood": like,
        "silhouette": _silhouette(done), "converged": model.summary.numIter < max_iter,
    }


METHODS = {"kmeans": kmeans, "hierarchical": hierarchical, "gmm": mixture}


def cluster(df: DataFrame, key: str, columns: Sequence[str] | None = None, method: str = "kmeans", k: int = 3) -> DataFrame:
    """``(key, cluster)`` of every row."""
    _, done, _ = METHODS[method](scaled(df, columns, [key]), k)
    return done.select(key, F.col("prediction").alias("cluster"))


def centres(df: DataFrame, columns: Sequence[str] | None = None, method: str = "kmeans", k: int = 3) -> DataFrame:
    """``(cluster, weight, centre)`` on the scaled columns: centres of k-means, means and weights of a mixture."""
    model, done, _ = METHODS[method](scaled(df, columns), k)
    if method == "gmm":
        rows = [(i, float(w), g.mean.toArray().tolist()) for i, (w, g) in enumerate(zip(model.weights, model.gaussians))]
    else:
        n = {r["prediction"]: r["count"] for r in done.groupBy("prediction").count().collect()}  # k rows
        total = sum(n.values())
        rows = [(i, n.get(i, 0) / total, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return df.sparkSession.createDataFrame(rows, "cluster int, weight double, centre array<double>")


def kmeans_check(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """One row: rows, rows that another centre is nearer to, and centres that are not their rows' mean."""
    model, done, _ = kmeans(scaled(df, columns), k)
    points = done.select(vector_to_array("features").alias("x"), "prediction")
    middle = [F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()]
    far = [F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) for m in middle]
    own = F.element_at(F.array(*far), F.col("prediction") + 1)
    misplaced = F.count_if(own > F.least(*far) + 1e-9) if k > 1 else F.lit(0).cast("long")
    d = len(model.clusterCenters()[0])
    means = points.groupBy("prediction").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(d)]).alias("m"))
    centre = F.element_at(F.array(*middle), F.col("prediction") + 1)
    apart = F.aggregate(F.zip_with("m", centre, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: F.greatest(s, v))
    return beside(points.agg(F.count(F.lit(1)).alias("rows"), misplaced.alias("misplaced")), means.agg(F.count_if(apart > 1e-3).alias("off_centre")))


def _metric_rows(spark, rows: Sequence[dict]) -> DataFrame:
    flat = [(r["method"], int(r["k"]), m, float(v)) for r in rows for m, v in r.items() if m not in ("method", "k") and v is not None]
    return spark.createDataFrame(flat, "method string, k int, metric string, value double")


def optimal_k(df: DataFrame, columns: Sequence[str] | None = None, method: str = "kmeans", max_k: int = 10) -> DataFrame:
    """Metrics for every k from 2 up; ``best`` marks the highest silhouette."""
    features = spread(scaled(df, columns).select("features"))
    top = min(max_k, features.count() - 1)
    ks = range(2, top + 1)
    if method == "kmeans":
        fits = kmeans_fits(features, ks) if ks else {}
        rows = [{"method": method, **_kmeans_done(features, k, *fits[k])[2]} for k in ks]
    else:
        rows = [{"method": method, **METHODS[method](features, k)[2]} for k in ks]
    out = _metric_rows(df.sparkSession, rows)
    scored = [r for r in rows if r["silhouette"] is not None]
    best = max(scored, key=lambda r: r["silhouette"])["k"] if scored else None
    return out.withColumn("best", F.col("k").eqNullSafe(F.lit(best)))


def compare_methods(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Metrics of all methods, at one k where a method takes one; the methods run side by side."""
    features = spread(scaled(df, columns).select("features"))

    def fitted(method: str) -> dict:
        return {"method": method, **METHODS[method](features, k)[2]}

    def dense() -> dict:
        points = features.select(F.monotonically_increasing_id().alias("_id"), vector_to_array("features").alias("x"))
        return {"method": "dbscan", **density_metrics(stage(density_labels(stage(points), "_id", eps, min_samples)))}

    return _metric_rows(df.sparkSession, together(df.sparkSession, [*[partial(fitted, m) for m in METHODS], dense]))


def cluster_stats(labelled: DataFrame, columns: Sequence[str], label: str = "cluster") -> DataFrame:
    """Size, share and distances to the cluster's own mean, per cluster."""
    means = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    total = means.agg(F.sum("size").alias("t"))
    far = F.sqrt(sum((F.pow(F.col(c) - F.col(f"_m{i}"), 2) for i, c in enumerate(columns)), F.lit(0.0)))
    return (
        join_groups(labelled, means, [label])
        .groupBy(label)
        .agg(F.max("size").alias("size"), F.avg(far).alias("mean_distance"), F.max(far).alias("max_distance"), F.min(far).alias("min_distance"))
        .withColumn("percent", F.col("size") * 100 / scalars(total).getField("t"))
    )


# --- density clustering -----------------------------------------------------------------------


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components ``(node, component)`` by alternating star operations.

    ``edges(u, v)`` over ids; each round links every node to the smallest id it
    knows, so chains shorten geometrically (Kiveris et al. 2014).
    """
    pairs = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
            .filter("u <> v")
            .distinct()
        )
        small = stage(small)
        if pairs.count() == small.count() and pairs.exceptAll(small).isEmpty():
            break
        pairs = small
    return nodes.join(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_c")), "node", "left").select(
        "node", F.coalesce("_c", "node").alias("component")
    )


#: Tiles that a tile meets on average, and tiles at least, before tiles grow; rows of the largest.
CROWDED, LARGE_LEAF = 16, 32_768


def _near(radius: float):
    """Ordered pairs of tiles with points within ``radius``, but not only such."""

    def choose(p: Boxes, q: Boxes) -> tuple[np.ndarray, np.ndarray]:
        found = [
            np.flatnonzero((p.gaps(i, q).sum(axis=1) <= radius * radius * (1 + 1e-12)) & (p.spans(i, q).sum(axis=1) > radius * radius * (1 - 1e-12)))
            for i in range(len(p.tile))
        ]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)

    return choose


def _inside(radius: float):
    """Ordered pairs of tiles whose boxes say that all their points lie within ``radius``."""

    def choose(p: Boxes, q: Boxes) -> tuple[np.ndarray, np.ndarray]:
        found = [np.flatnonzero(p.spans(i, q).sum(axis=1) <= radius * radius * (1 - 1e-12)) for i in range(len(p.tile))]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)

    return choose


def _weights(near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The summed weights of each row's neighbours."""
    if (w == w[0]).all():
        return np.count_nonzero(near, axis=1) * int(w[0])
    return near @ w


def _neighbour_weight(radius: float, cells: int = 2**21):
    """Of a pair of tiles: the weight that each point of either has near it in the other; within one tile, in it.

    Where rows have ``few``, only points with it are told of.
    """

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = rows_of(left.column("x")), rows_of(right.column("x"))
        v, w = left.column("w").to_numpy(), right.column("w").to_numpy()
        same = left.column("tile")[0] == right.column("tile")[0]
        some = "few" in left.column_names
        p, q = ((t.column("few").to_numpy(zero_copy_only=False) if some else np.ones(len(t), dtype=bool)) for t in (left, right))
        n, m = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        both = some and p.sum() * len(y) + len(x) * q.sum() < len(x) * len(y)
        # Few points on either side are compared with all of the other's; else all with all, once.
        mine = np.flatnonzero(p) if both else np.arange(len(x))
        block = max(1, cells // max(1, len(y)))
        for lo in range(0, len(mine), block):
            at = mine[lo : lo + block]
            near = within(x[at], y, radius)
            n[at] = _weights(near, w)
            if not same and not both:
                m += _weights(near.T, v[at])
        if both and not same:
            theirs = np.flatnonzero(q)
            block = max(1, cells // max(1, len(x)))
            for lo in range(0, len(theirs), block):
                at = theirs[lo : lo + block]
                m[at] = _weights(within(y[at], x, radius), v)
        found = pa.table({"id": left.column("id"), "n": n}).filter(pa.array(p & (n > 0)))
        return found if same else pa.concat_tables([found, pa.table({"id": right.column("id"), "n": m}).filter(pa.array(q & (m > 0)))])

    return count


def _contacts(radius: float, cells: int = 2**21):
    """Of the core points of a pair of tiles: links to the least one of their group.

    Where rows have a ``component``, points that are of the other tile's only one need no link.
    """

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        if not len(left) or not len(right):
            return none
        if "component" in left.column_names and left.column("tile")[0] != right.column("tile")[0]:
            p, q = left.column("component").to_numpy(), right.column("component").to_numpy()
            left, right = (t.filter(pa.array((own != other[0]) | (other != other[0]).any())) for t, own, other in ((left, p, q), (right, q, p)))
        if not len(left) or not len(right):
            return none
        x, y = rows_of(left.column("x")), rows_of(right.column("x"))
        ids = np.concatenate([left.column("id").to_numpy(), right.column("id").to_numpy()])
        order = np.argsort(ids, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(ids))  # so that the least place is the least id
        label = np.arange(len(ids))
        block = max(1, cells // max(1, len(y)))
        for lo in range(0, len(x), block):
            i, j = np.divmod(np.flatnonzero(within(x[lo : lo + block], y, radius)), len(y))
            label = joined(label, place[i + lo], place[j + len(x)])
        ids = ids[order]
        moved = np.flatnonzero((label != np.arange(len(ids))) & (ids[label] != ids))
        return pa.table({"u": ids[moved], "v": ids[label[moved]]})

    return link


def _touches(radius: float, cells: int = 2**21):
    """Of a tile of other points and one of core points: which clusters those lie near."""

    def touch(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):
            return pa.table({"id": pa.array([], pa.int64()), "cluster": pa.array([], pa.int64())})
        x, y = rows_of(left.column("x")), rows_of(right.column("x"))
        cluster = right.column("cluster").to_numpy()
        order = np.argsort(cluster, kind="stable")
        y, cluster = y[order], cluster[order]
        first = np.full(len(x), -1, dtype=np.int64)
        block = max(1, cells // max(1, len(y)))
        for lo in range(0, len(x), block):
            near = within(x[lo : lo + block], y, radius)
            first[lo : lo + block] = np.where(near.any(axis=1), cluster[near.argmax(axis=1)], -1)
        return pa.table({"id": left.column("id"), "cluster": first}).filter(pa.array(first >= 0))

    return touch


def _reachable(radius: float):
    """Pairs of tiles with points within ``radius``."""

    def choose(p: Boxes, q: Boxes) -> tuple[np.ndarray, np.ndarray]:
        found = [np.flatnonzero(p.gaps(i, q).sum(axis=1) <= radius * radius * (1 + 1e-12)) for i in range(len(p.tile))]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)

    return choose


def _met_tiles(unique: DataFrame, width: int, eps: float, leaf: int) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    tiles = tiled(unique, width, leaf)
    around = boxes(tiles)
    n = around.count()
    return tiles, around, n, box_pairs(around, around, (n, n), _near(eps))


def density_labels(points: DataFrame, key: str, eps: float, min_samples: int, leaf: int = LEAF) -> DataFrame:
    """``(key, x, cluster, is_core)`` of ``points`` (key, x) by DBSCAN, in any number of columns.

    Equal points are one of their weight. Tiles of points meet where their boxes
    come within ``eps``; where boxes lie within it as a whole, nothing is
    compared, so a crowd costs as much as its tiles. Clusters are numbered by
    their least core key, and a border point near several joins the first of
    them: the numbers depend on keys and points alone. Noise is -1.
    """
    unique = points.groupBy("x").agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("first")).withColumn("id", F.monotonically_increasing_id())
    unique = stage(unique)
    head = unique.select(F.size("x")).first()
    if head is None:
        return points.select(key, "x", F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("is_core"))
    tiles, around, n, near = _met_tiles(unique, head[0], eps, leaf)
    total = unique.count()
    if near.count() > CROWDED * n and total > CROWDED * leaf:
        # Boxes rule out little, so rows are sent once for every other tile: fewer, larger tiles.
        tiles, around, n, near = _met_tiles(unique, head[0], eps, max(leaf, min(LARGE_LEAF, total // CROWDED)))
    inside = box_pairs(around, around, (n, n), _inside(eps))
    own, cross = near.filter("a = b"), near.filter("a < b")  # a pair of tiles tells of both

    whole = inside.join(around.select(F.col("tile").alias("b"), "w"), "b").groupBy(F.col("a").alias("tile")).agg(F.sum("w").alias("all"))
    some = compare(tiles, tiles, own, _neighbour_weight(eps), "id long, n long")
    size = F.coalesce("all", F.lit(0)) + F.coalesce("n", F.lit(0))
    counted = tiles.join(whole, "tile", "left").join(some, "id", "left").select("tile", "id", "w", "x", size.alias("size"))
    # What is core by its own tile and those wholly within reach is counted no further.
    counted = stage(counted.withColumn("few", F.col("size") < min_samples))
    asking = counted.filter("few").select("tile").distinct()
    asked = stage(cross.join(asking.withColumnRenamed("tile", "a"), "a", "left_semi").unionByName(cross.join(asking.withColumnRenamed("tile", "b"), "b", "left_semi").select("a", "b")).distinct())
    rows = counted.select("tile", "id", "w", "x", "few")
    some = compare(rows, rows, asked, _neighbour_weight(eps), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    tiles = stage(counted.join(some, "id", "left").select("tile", "id", "w", "x", (F.col("size") + F.coalesce("n", F.lit(0)) >= min_samples).alias("core")))

    core = tiles.filter("core").drop("core")
    # Each tile meets itself and one other; then only pairs of tiles that are not of one component as a whole.
    chain = stage(cross.groupBy("a").agg(F.min("b").alias("b")))
    met = stage(compare(core, core, stage(own.unionByName(chain)), _contacts(eps), "u long, v long"))
    reps = core.groupBy("tile").agg(F.min("id").alias("rep"))
    # Of boxes wholly within reach: every core point is near all of the other tile's.
    reached = stage(inside.join(reps.select(F.col("tile").alias("b"), "rep"), "b").select("a", "b", "rep"))
    least = reached.groupBy(F.col("a").alias("tile")).agg(F.min("rep").alias("v"))
    edges = (
        met.select("u", "v")
        .unionByName(core.join(least, "tile").select(F.col("id").alias("u"), "v"))
        .unionByName(reached.join(reps.select(F.col("tile").alias("a"), F.col("rep").alias("u")), "a").select("u", F.col("rep").alias("v")))
    )
    groups = stage(components(edges, core.select(F.col("id").alias("node"))))
    held = core.join(groups.withColumnRenamed("node", "id"), "id").select("tile", "id", "w", "x", "component")
    ends = stage(held.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
    of = lambda k: ends.select(F.col("tile").alias(k), F.col("lo").alias(f"{k}_lo"), F.col("hi").alias(f"{k}_hi"))
    rest = cross.join(chain, ["a", "b"], "left_anti").join(of("a"), "a").join(of("b"), "b")
    rest = stage(rest.filter("NOT (a_lo = a_hi AND b_lo = b_hi AND a_lo = b_lo)").select("a", "b"))
    if not rest.isEmpty():
        met = compare(held, held, rest, _contacts(eps), "u long, v long")
        part = lambda k: groups.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
        met = met.join(part("u"), "u").join(part("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct()
        wider = components(met, groups.select(F.col("component").alias("node")).distinct()).select(F.col("node").alias("component"), F.col("component").alias("_c"))
        groups = stage(groups.join(wider, "component").select("node", F.col("_c").alias("component")))
    named = groups.join(unique.select(F.col("id").alias("node"), "first"), "node")
    from tablewright.operators.ranks import row_index

    numbers = row_index(named.groupBy("component").agg(F.min("first").alias("_least")), ["_least", "component"], name="cluster").select("component", "cluster")
    of_core = stage(groups.join(numbers, "component").select(F.col("node").alias("id"), "cluster"))
    # Other points are cut into tiles of their own, so that core points are sent once for as many as fill one.
    others = stage(tiles.filter("NOT core").select("id", "w", "x"))
    border = of_core.limit(0)
    if not others.isEmpty() and not of_core.isEmpty():
        alone, pairs = tiled_against(others, head[0], leaf, around, n, _reachable(eps))
        border = compare(alone, core.join(of_core, "id"), pairs, _touches(eps), "id long, cluster long").groupBy("id").agg(F.min("cluster").alias("cluster"))
    labelled = of_core.select("id", "cluster", F.lit(True).alias("is_core")).unionByName(border.select("id", "cluster", F.lit(False).alias("is_core")))
    of_point = unique.select("x", "id").join(labelled, "id", "left").select("x", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    return points.join(of_point, "x").select(key, "x", "cluster", "is_core")


def dbscan(
    df: DataFrame, key: str, columns: Sequence[str] | None = None, eps: float = 0.5, min_samples: int = 5, with_core: bool = False, leaf: int = LEAF
) -> DataFrame:
    """Exact DBSCAN on scaled columns: ``(key, cluster)`` as :func:`density_labels` numbers them; ``with_core`` adds ``is_core``."""
    done = density_labels(arrays(scaled(df, columns, [key]), [key]), key, eps, min_samples, leaf)
    return done.select(key, "cluster", *(["is_core"] if with_core else []))


def density_metrics(labelled: DataFrame) -> dict:
    """Clusters, noise rows and share, and the silhouette of the rows that are not noise (none with fewer than two clusters)."""
    noise = F.col("cluster") < 0
    n, lost, found = labelled.agg(F.count(F.lit(1)), F.count_if(noise), F.count_distinct(F.when(~noise, F.col("cluster")))).first()
    kept = labelled.filter(~noise).select(array_to_vector("x").alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return {"k": found, "n_noise": lost, "noise_ratio": lost / n if n else 0.0, "silhouette": _silhouette(kept) if found > 1 else None}
