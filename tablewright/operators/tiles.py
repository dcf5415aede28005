"""Tiles of nearby rows with bounding boxes, and work on the pairs of tiles that may matter.

Searches by distance cut the rows into tiles of bounded size, nearby rows
together. From the boxes alone it follows which pairs of tiles can hold what is
looked for; only those meet, each pair in a task of its own. Rows are
``(id, w, x)``: a number, a weight (equal rows may act as one), and an array of
doubles in which NaN is a gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import stage

#: Rows of a tile, tiles that one task cuts, tiles whose boxes one task compares with as many others.
LEAF, CUT, BOXES = 4096, 16, 1024

#: Columns from which on products are of single precision.
SINGLE = 16

#: Tasks that pairs of tiles are dealt over where there are as many pairs; more if the session has more shuffle partitions.
TASKS = 256

_ROW = "id long, w long, x array<double>"


def rows_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of equal length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _halves(x: np.ndarray, rows: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """``rows`` of one gap pattern, halved along their widest column until they fit."""
    todo = [rows]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            yield rows
            continue
        own = x[rows]
        with np.errstate(invalid="ignore"):
            span = np.nan_to_num(own.max(axis=0) - own.min(axis=0), nan=-1)
        order = rows[np.argsort(own[:, span.argmax()], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]


def leaves(x: np.ndarray, leaf: int) -> Iterator[np.ndarray]:
    """Row numbers of each tile: tiles of one gap pattern where it has enough rows, mixed ones for the rest."""
    _, pattern = np.unique(np.isnan(x), axis=0, return_inverse=True)
    order = np.argsort(pattern.ravel(), kind="stable")
    rest: list[np.ndarray] = []
    for rows in np.split(order, np.flatnonzero(np.diff(pattern.ravel()[order])) + 1):
        if 2 * len(rows) >= leaf:
            yield from _halves(x, rows, leaf)
            continue
        rest.append(rows)
        if sum(map(len, rest)) >= leaf:
            yield np.concatenate(rest)
            rest = []
    if rest:
        yield np.concatenate(rest)


def tiled(points: DataFrame, width: int, leaf: int = LEAF) -> DataFrame:
    """``(tile, id, w, x)`` of staged ``points`` of ``width`` columns, tiles of at most 3/2 ``leaf`` rows; itself staged."""
    n, *spread = points.selectExpr("count(*)", *[f"var_pop(nullif(x[{i}], double('NaN')))" for i in range(width)]).first()
    widest = max(range(width), key=lambda i: spread[i] if spread[i] is not None and spread[i] == spread[i] else -1.0)
    pattern = F.array_join(F.transform("x", lambda v: F.when(F.isnan(v), "1").otherwise("0")), "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        part = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(leaves(rows_of(table.column("x")), leaf)):
            own = table.take(pa.array(rows)).combine_chunks()
            yield from own.add_column(0, "tile", pa.array(np.full(len(rows), part + k, np.int64))).to_batches()

    # Large tiles are cut by two: a task holds what it cuts.
    held = min(CUT * leaf, max(CUT * LEAF, 2 * leaf))
    near = points.select("id", "w", "x").repartitionByRange(max(1, -(-n // held)), pattern, F.col("x")[widest], "id")
    return stage(near.mapInArrow(cut, f"tile long, {_ROW}"))


def boxes(tiles: DataFrame) -> DataFrame:
    """One row a tile: weight ``w``, and per column ``lo``, ``hi`` (NaN without values) and the weight ``has`` of rows that have it."""

    def box(table: pa.Table) -> pa.Table:
        x, w = rows_of(table.column("x")), table.column("w").to_numpy()
        have = ~np.isnan(x)
        lo, hi = np.where(have, x, np.inf).min(axis=0), np.where(have, x, -np.inf).max(axis=0)
        none = ~have.any(axis=0)
        lo[none] = hi[none] = np.nan
        return pa.table({"tile": table.column("tile")[:1], "w": pa.array([int(w.sum())]), "lo": [lo], "hi": [hi], "has": [(have * w[:, None]).sum(axis=0).astype(np.int64)]})

    return stage(tiles.groupBy("tile").applyInArrow(box, "tile long, w long, lo array<double>, hi array<double>, has array<long>"))


class Boxes:
    """The boxes of some tiles as matrices, one row a tile."""

    def __init__(self, table: pa.Table) -> None:
        self.tile, self.w = table.column("tile").to_numpy(), table.column("w").to_numpy()
        self.lo, self.hi, self.has = (rows_of(table.column(c)) for c in ("lo", "hi", "has"))
        self.table = table

    def gaps(self, i: int, other: Boxes) -> np.ndarray:
        """Squared least distance in each column between box ``i`` and every other; 0 where one has no values."""
        gap = np.maximum(0, np.maximum(self.lo[i] - other.hi, other.lo - self.hi[i]))
        return np.nan_to_num(gap) ** 2

    def spans(self, i: int, other: Boxes) -> np.ndarray:
        """Squared largest distance in each column between box ``i`` and every other."""
        return np.nan_to_num(np.maximum(self.hi[i] - other.lo, other.hi - self.lo[i])) ** 2


def box_pairs(left: DataFrame, right: DataFrame, counts: tuple[int, int], choose: Callable[[Boxes, Boxes], tuple[np.ndarray, ...]]) -> DataFrame:
    """Pairs ``(a, b)`` of tiles that ``choose`` gives, as places in either, for boxes of ``left`` and ``right``.

    Both sides, of ``counts`` boxes, are dealt into blocks of about ``BOXES``; every two blocks meet in one task.
    """
    dealt = []
    counts = tuple(max(1, -(-n // BOXES)) for n in counts)
    for side, df in enumerate((left, right)):
        own = F.pmod(F.xxhash64("tile"), F.lit(counts[side])).cast("int")
        others = F.explode(F.sequence(F.lit(0), F.lit(counts[1 - side] - 1)))
        names = ("left", "right") if side == 0 else ("right", "left")
        dealt.append(df.select(own.alias(names[0]), others.alias(names[1]), F.lit(side).alias("side"), *df.columns))

    def meet(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        mine, theirs = (Boxes(table.filter(pa.array(side == s))) for s in (0, 1))
        i, j = choose(mine, theirs) if len(mine.tile) and len(theirs.tile) else (np.zeros(0, int), np.zeros(0, int))
        return pa.table({"a": pa.array(mine.tile[i]), "b": pa.array(theirs.tile[j])})

    both = dealt[0].unionByName(dealt[1], allowMissingColumns=True)
    return stage(both.groupBy("left", "right").applyInArrow(meet, "a long, b long"))


def tiled_against(points: DataFrame, width: int, leaf: int, right: DataFrame, count: int, choose: Callable[[Boxes, Boxes], tuple[np.ndarray, ...]]) -> tuple[DataFrame, DataFrame]:
    """Tiles of ``points``, and their pairs with the ``count`` boxes of ``right`` that ``choose`` gives."""
    tiles = tiled(points, width, leaf)
    left = boxes(tiles)
    return tiles, box_pairs(left, right, (left.count(), count), choose)


def compare(left: DataFrame, right: DataFrame, pairs: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` of the rows of tile ``a`` of ``left`` and of tile ``b`` of ``right``, for each of the staged pairs of tiles.

    A pair is few bytes but much work: the number of tasks follows the pairs,
    which Spark would else put into as few tasks as their bytes fill.
    """
    tasks = max(1, min(pairs.count(), max(TASKS, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    met = [
        rows.join(pairs.select("a", "b"), F.col("tile") == F.col(at)).withColumn("side", F.lit(side))
        for side, (rows, at) in enumerate(((left, "a"), (right, "b")))
    ]

    def both(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        return fn(table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1)))

    dealt = met[0].unionByName(met[1], allowMissingColumns=True).repartition(tasks, "a", "b")
    return dealt.groupBy("a", "b").applyInArrow(both, schema)


def within(x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Which rows of ``y`` lie within ``radius`` of which rows of ``x``.

    Products decide all but the pairs that rounding may put on either side; those are measured directly.
    Of many columns the products are of single precision where few pairs lie that near the radius.
    """
    middle = y.mean(axis=0)
    u, v = x - middle, y - middle
    a, b = (u * u).sum(axis=1), (v * v).sum(axis=1)
    most = float(a.max(initial=0) + b.max(initial=0))
    # A product of d columns is off by (d + 2) roundings of |u| |v| at most, and the sums by a few of all parts.
    single = x.shape[1] >= SINGLE and radius * radius > most * 1e-3 and most < 1e30
    loose = (x.shape[1] + 8) * 2.0**-23 * (a + b.max()) if single else 1e-12 * (a + b.max())
    kind = np.float32 if single else np.float64
    # Squared distances less the left row's own part.
    part = u.astype(kind) @ (-2 * v).astype(kind).T
    part += b.astype(kind)
    low, high = ((radius * radius - a + s * loose).astype(kind)[:, None] for s in (-1, 1))
    near = part <= low
    i, j = np.divmod(np.flatnonzero((part <= high) ^ near), len(y))
    step = max(1, 2**22 // max(1, x.shape[1]))
    for lo in range(0, len(i), step):
        p, q = i[lo : lo + step], j[lo : lo + step]
        near[p, q] = ((x[p] - y[q]) ** 2).sum(axis=1) <= radius * radius
    return near


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (the least member of each node's group) after the links ``a`` - ``b`` have joined groups."""
    while True:
        p, q = label[a], label[b]
        apart = p != q
        if not apart.any():
            return label
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        label = label.copy()
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := label[label], label):
            label = up
