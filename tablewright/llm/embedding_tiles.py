"""Near-duplicate embeddings by tiles whose dimensions are ordered by principal components.

Unit vectors are rotated so that the leading dimensions carry most of their
length, and sorted into tiles by those dimensions. Two tiles whose boxes lie
further apart than the threshold allows never meet. Of the others, all pairs'
products are accumulated a few dimensions at a time: what the remaining
dimensions can add is at most the product of the two suffix norms, so a pair
stops as soon as it cannot reach the threshold any more, and a block of pairs
as soon as none of them can. Equal vectors are one weighted vector.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, group_join, spread_join, staged
from tablewright.llm.simhash import link_components

COSINE = 0.95

#: Rows of a tile, pairs looked at together (rows by rows), dimensions added at a time, and tiles of a block of tiles.
TILE, BLOCK, STEP, TILES = 32_768, 1_024, 16, 1_024

#: Rounding of the rotated products; closer to the threshold than this, the vectors as given decide.
ROUNDING = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of doubles, with zeros up to width ``d``."""
    lengths = column.value_lengths().to_numpy()
    out = np.zeros((len(column), d))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == d).all():
        out[:] = flat.reshape(-1, d)
    else:
        out[np.arange(d) < lengths[:, None]] = flat
    return out


def _moments(d: int):
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                u = _unit(_matrix(batch.column(0).slice(at, 4 * BLOCK), d))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.ravel())], ["i", "v"])

    return moments


def principal_axes(vectors: DataFrame, d: int) -> np.ndarray:
    """The orthogonal d x d matrix whose columns are the axes of ``v``'s unit vectors, longest first.

    Every task adds up one d x d matrix; d x d numbers come to the driver.
    """
    sums = vectors.select("v").mapInArrow(_moments(d), "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    moment = np.zeros(d * d)
    for r in sums.collect():
        moment[r["i"]] = r["v"]
    values, axes = np.linalg.eigh(moment.reshape(d, d))
    return axes[:, np.argsort(-values, kind="stable")]


def _placer(axes: np.ndarray, lead: int):
    d = len(axes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BLOCK):
                part = batch.slice(at, 4 * BLOCK)
                y = _unit(_matrix(part.column(2), d)) @ axes[:, :lead]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(np.ascontiguousarray(c)) for c in y.T]], [*part.schema.names, *[f"y{i}" for i in range(lead)]])

    return place


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a partition with their places in it."""
    seen = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(seen, seen + batch.num_rows)), *batch.columns], ["place", *batch.schema.names])
        seen += batch.num_rows


def _boxes(axes: np.ndarray):
    d = len(axes)

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, widths = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy()
            for at in range(0, batch.num_rows, 4 * BLOCK):
                y = _unit(_matrix(batch.column(1).slice(at, 4 * BLOCK), d)) @ axes
                mine, width = tiles[at : at + 4 * BLOCK], widths[at : at + 4 * BLOCK]
                for t in np.unique(mine):
                    own = y[mine == t]
                    lo, hi = own.min(axis=0), own.max(axis=0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(d, t)), pa.array(np.arange(d, dtype=np.int32)), pa.array(lo), pa.array(hi), pa.array(np.full(d, width[mine == t].min(), np.int32)), pa.array(np.full(d, width[mine == t].max(), np.int32))],
                        ["tile", "i", "lo", "hi", "narrow", "broad"],
                    )

    return box


def _meeting(cosine: float):
    """Pairs of tiles, of two blocks of tiles, that may hold a link."""
    reach = 2 - 2 * cosine + ROUNDING

    def meet(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        block = table.column("block").to_numpy()
        tile = table.column("tile").to_numpy()
        lo, hi = (np.stack([np.asarray(x) for x in table.column(c).to_pylist()]) for c in ("lo", "hi"))
        narrow, broad = table.column("narrow").to_numpy(), table.column("broad").to_numpy()
        left, right = np.flatnonzero(block == key["a"]), np.flatnonzero(block == key["b"])
        a, b = [tile[:0]], [tile[:0]]
        for i in left:
            gap = np.maximum(0, np.maximum(lo[i] - hi[right], lo[right] - hi[i]))
            near = ((gap * gap).sum(axis=1) <= reach) & (narrow[i] <= broad[right]) & (narrow[right] <= broad[i])
            near &= (tile[right] >= tile[i]) if key["a"] == key["b"] else True
            b.append(tile[right[near]])
            a.append(np.full(len(b[-1]), tile[i]))
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return meet


def tile_links(x: np.ndarray, y: np.ndarray, axes: np.ndarray, cosine: float, same: bool, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of x, row of y) of cosine ``cosine`` or more, block by block; with ``same`` only those above the diagonal."""
    d = len(axes)
    left, right = _unit(x), _unit(y)
    u, v = left @ axes, right @ axes
    ends = [*range(STEP, d, STEP), d]
    after = [(np.sqrt((u[:, e:] ** 2).sum(axis=1)), np.sqrt((v[:, e:] ** 2).sum(axis=1))) for e in ends]
    # The first step as one product in single precision: leading dimensions, and the suffix norms as one more.
    head = [np.concatenate([m[:, : ends[0]], after[0][k][:, None]], axis=1).astype(np.float32) for k, m in enumerate((u, v))]
    open_ = np.float32(cosine - 1e-4)
    for r in range(0, len(u), block):
        for c in range(r if same else 0, len(v), block):
            may = head[0][r : r + block] @ head[1][c : c + block].T >= open_
            n = np.count_nonzero(may)
            if not n:
                continue
            if n > may.size // 50:
                # Crowded: whole products of the block cost less than gathering its pairs.
                product = u[r : r + block] @ v[c : c + block].T
                i, j = np.nonzero(may & (product >= cosine - ROUNDING))
                product = product[i, j]
                i, j = i + r, j + c
            else:
                i, j = np.nonzero(may)
                i, j, product, at = i + r, j + c, np.zeros(n), 0
                for k, end in enumerate(ends):
                    product += np.einsum("nd,nd->n", u[i, at:end], v[j, at:end])
                    alive = product + after[k][0][i] * after[k][1][j] >= cosine - ROUNDING
                    i, j, product, at = i[alive], j[alive], product[alive], end
                    if not len(i):
                        break
            if same:
                above = j > i
                i, j, product = i[above], j[above], product[above]
            close = np.flatnonzero(product < cosine + ROUNDING)
            if len(close):
                direct = (left[i[close]] * right[j[close]]).sum(axis=1)
                good = np.ones(len(i), bool)
                good[close] = direct >= cosine
                i, j = i[good], j[good]
            if len(i):
                yield i, j


def _comparer(axes: np.ndarray, cosine: float):
    d = len(axes)

    def compare(table: pa.Table) -> pa.Table:
        """For the vectors of a pair of tiles: linked rows of each, and the smallest vector of its component here."""
        table = table.sort_by("cid")
        ids, size, tile = table.column("cid").to_numpy(), table.column("size").to_numpy(), table.column("tile").to_numpy()
        key = table.column("key")[0].as_py()
        vectors = table.column("v").combine_chunks()
        width = vectors.value_lengths().to_numpy()
        linked, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for w in np.unique(width):
            a, b = (np.flatnonzero((tile == key[s]) & (width == w)) for s in "ab")
            same = key["a"] == key["b"]
            x = _matrix(vectors.take(pa.array(a)), d)
            y = x if same else _matrix(vectors.take(pa.array(b)), d)
            for i, j in tile_links(x, y, axes, cosine, same, BLOCK):
                i, j = a[i], b[j]
                np.add.at(linked, i, size[j])
                np.add.at(linked, j, size[i])
                new = label[i] != label[j]
                if new.any():
                    label = components(len(ids), label[i[new]], label[j[new]])[label]
        some = np.flatnonzero(linked)
        return pa.table({"cid": ids[some], "linked": linked[some], "root": ids[label[some]]})

    return compare


def near_embeddings(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Rows link when the cosine of their ``embedding`` arrays is ``cosine`` (above
    0) or more, in double precision. n_links counts the other rows linked
    directly, equal vectors included; component_id is the smallest vec_id
    reachable, the row itself included, null ids passed over unless there is no
    other; kept marks the rows with that id. Vectors that are null, empty, zero or
    hold null or non-finite components, and vectors of different lengths, link
    with nothing. Rows that repeat a vec_id are rows of their own. Other columns
    are ignored; an empty table gives an empty result.
    """
    if not cosine > 0:
        raise ValueError("the threshold has to be above 0")
    spark = embeddings.sparkSession
    usable = F.size("v") > 0
    usable &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    # Adding zero makes one zero of the two.
    read = embeddings.select("vec_id", F.col("embedding").alias("v")).withColumn("ok", F.coalesce(usable, F.lit(False)))
    alone = read.filter("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = staged(read.filter("ok").select("vec_id", F.transform("v", lambda x: x + F.lit(0).cast("float")).alias("v")), "vectors")
    classes = rows.groupBy("v").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()).select("cid", "size", "v", "first"), "classes")
    total, d = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if total:
        axes = principal_axes(classes, d)
        near = staged(_linked(classes, total, axes, cosine), "near")
        # Stars of every pair of tiles; all their nodes have a row here.
        sums = near.groupBy("cid").agg(F.sum("linked").alias("linked"))
        roots = link_components(near.select(F.col("cid").alias("a"), F.col("root").alias("b")))
        named = classes.join(sums, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
        named = staged(named.select("v", "size", "first", "linked", F.coalesce("root", "cid").alias("root")), "named")
        least = group_join(named, "root", "first", component_id=(F.min("first"), F.min))
        found = spread_join(rows, "v", "vec_id", least.select("v", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"))
        alone = alone.unionByName(found.select("vec_id", "n_links", "component_id"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(classes: DataFrame, total: int, axes: np.ndarray, cosine: float) -> DataFrame:
    """cid, linked and root for every pair of tiles and every vector with a link there."""
    spark = classes.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # Enough pairs of tiles for all cores, tiles no larger than a worker holds.
    size = min(TILE, max(BLOCK, -(-total // math.isqrt(8 * cores))))
    tiles = -(-total // size)
    lead = min(4, len(axes))
    kind = classes.schema["v"].dataType.simpleString()
    ys = [f"y{i}" for i in range(lead)]
    placed = staged(
        classes.select("cid", "size", "v").mapInArrow(_placer(axes, lead), f"cid long, size long, v {kind}, " + ", ".join(f"{y} double" for y in ys)),
        "placed",
    )
    # Slabs by quantiles of the leading dimensions, so that tiles are small in all of them.
    slabs = max(1, round(tiles ** (1 / (lead - 1)))) if lead > 1 else 1
    edges = placed.approxQuantile(ys[:-1], [k / slabs for k in range(1, slabs)], 0.01) if slabs > 1 else [[] for _ in ys[:-1]]
    slab = [F.size(F.filter(F.array(*[F.lit(float(e)) for e in cut]), lambda e: e < F.col(y))) if cut else F.lit(0) for y, cut in zip(ys, edges)]  # noqa: B023
    keyed = placed.withColumns({f"s{i}": s for i, s in enumerate(slab)})
    order = [F.size("v"), *[f"s{i}" for i in range(len(slab))], ys[-1], "cid"]
    sorted_ = keyed.repartitionByRange(tiles, *order).sortWithinPartitions(*order).select("cid", "size", "v", F.spark_partition_id().alias("p"))
    sorted_ = staged(sorted_.mapInArrow(_numbered, f"place long, cid long, size long, v {kind}, p int"), "sorted")
    # One number a partition comes to the driver: the rows before it.
    held = {r["p"]: r["count"] for r in sorted_.groupBy("p").count().collect()}
    before = [0, *itertools.accumulate(held.get(p, 0) for p in range(max(held)))]
    rank = F.element_at(F.lit(before), F.col("p") + 1) + F.col("place")
    tiled = sorted_.select(F.floor(rank / size).alias("tile"), "cid", "size", "v")

    boxes = tiled.select("tile", "v").mapInArrow(_boxes(axes), "tile long, i int, lo double, hi double, narrow int, broad int")
    boxes = boxes.groupBy("tile", "i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("narrow").alias("narrow"), F.max("broad").alias("broad"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c])
    boxes = boxes.groupBy("tile").agg(in_order("lo").alias("lo"), in_order("hi").alias("hi"), F.min("narrow").alias("narrow"), F.max("broad").alias("broad"))
    blocks = -(-tiles // TILES)
    boxes = boxes.withColumn("block", F.pmod(F.xxhash64("tile"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    dealt = boxes.select("*", other).withColumn("key", F.struct(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))).drop("other")
    meetings = staged(dealt.groupBy("key").applyInArrow(_meeting(cosine), "a long, b long"), "meetings")

    sides = meetings.select(F.struct("a", "b").alias("key"), F.explode(F.array_distinct(F.array("a", "b"))).alias("tile"))
    pairs = tiled.join(sides, "tile").groupBy("key").applyInArrow(_comparer(axes, cosine), "cid long, linked long, root long")
    return pairs
