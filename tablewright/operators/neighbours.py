"""Exact nearest neighbours without comparing all pairs, and what is built on them.

Queries and donors are cut into tiles of nearby rows. How far a tile's k-th
neighbour can lie follows from the boxes alone; a donor is sent only to the
tiles whose bound it may beat, and read there as a stream that leaves the
nearest so far. Equal rows are one weighted donor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.operators.columns import numeric_columns
from tablewright.operators.features import arrays, scaled
from tablewright.operators.tiles import LEAF, Boxes, box_pairs, boxes, compare, rows_of, tiled
from tablewright.session import attach, stage

#: Rows of a block of queries, at least and at most, and blocks that a search is cut into where the rows allow.
ASKING, BLOCKS = (512, 16_384), 32


def _reached(wanted: int):
    """Donor tiles that may hold one of the ``wanted`` nearest donors of some row of a tile, by the boxes."""

    def choose(q: Boxes, d: Boxes) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for i in range(len(q.tile)):
            spans = q.spans(i, d).sum(axis=1)
            order = np.argsort(spans, kind="stable")
            enough = np.searchsorted(np.cumsum(d.w[order]), wanted)
            limit = spans[order[enough]] if enough < len(order) else np.inf
            found.append(np.flatnonzero(q.gaps(i, d).sum(axis=1) <= limit * (1 + 1e-9)))
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)

    return choose


class _Nearest:
    """The ``wanted`` nearest donors so far of a block of queries, whose donors come a batch at a time."""

    def __init__(self, wanted: int) -> None:
        self.wanted, self.ids, self.x = wanted, np.zeros(0, np.int64), None
        self.waiting: list[pa.RecordBatch] = []

    def ask(self, batch: pa.RecordBatch) -> None:
        self.waiting.append(batch)

    def _begin(self) -> None:
        self.ids = np.concatenate([b.column("id").to_numpy() for b in self.waiting])
        self.x = np.concatenate([rows_of(b.column("x")) for b in self.waiting])
        shape = (len(self.ids), self.wanted)
        self.far, self.did, self.w = np.full(shape, np.inf), np.full(shape, -1, np.int64), np.zeros(shape, np.int64)

    def meet(self, batch: pa.RecordBatch, block: int = 128) -> None:
        if self.x is None:
            self._begin()
        ids, w, y = batch.column("id").to_numpy(), batch.column("w").to_numpy(), rows_of(batch.column("x"))
        gap = (np.maximum(0, np.maximum(y.min(axis=0) - self.x, self.x - y.max(axis=0))) ** 2).sum(axis=1)
        able = np.flatnonzero(gap <= self.far[:, -1] ** 2 * (1 + 1e-9))
        middle = y.mean(axis=0)
        v = y - middle
        double, b = -2 * v, (v * v).sum(axis=1)
        for lo in range(0, len(able), block):
            rows = able[lo : lo + block]
            u = self.x[rows] - middle
            a = (u * u).sum(axis=1)
            loose = 1e-12 * (a + b.max())
            # Squared distances less the row's own part.
            near = u @ double.T
            near += b
            top = self.far[rows, -1] ** 2 * (1 + 1e-9)
            if len(ids) > self.wanted and not np.isfinite(top).all():
                top = np.minimum(top, np.partition(near, self.wanted - 1, axis=1)[:, self.wanted - 1] + a + loose)
            # Products tell who may be near; the differences of those decide.
            i, j = np.divmod(np.flatnonzero(near <= (top - a + loose)[:, None]), len(ids))
            if len(i):
                self._take(rows, i, ids[j], w[j], np.sqrt(((self.x[rows[i]] - y[j]) ** 2).sum(axis=1)))

    def _take(self, rows: np.ndarray, i: np.ndarray, did: np.ndarray, w: np.ndarray, far: np.ndarray) -> None:
        hit, i = np.unique(i, return_inverse=True)
        rows = rows[hit]
        i = np.concatenate([np.repeat(np.arange(len(rows)), self.wanted), i])
        far, did, w = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.far, far), (self.did, did), (self.w, w)))
        order = np.lexsort((did, far, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < self.wanted
        at = rows[i[keep]], place[keep]
        self.far[at], self.did[at], self.w[at] = far[order][keep], did[order][keep], w[order][keep]

    def found(self, k: int, same: bool) -> pa.RecordBatch:
        if self.x is None:
            self._begin()
        size = self.w - (self.did == self.ids[:, None]) if same else self.w
        used = np.clip(k - (np.cumsum(size, axis=1) - size), 0, size)
        i, j = np.nonzero(used)
        return pa.RecordBatch.from_pydict({"qid": self.ids[i], "did": self.did[i, j], "distance": self.far[i, j], "weight": used[i, j]})


def _numbered(rows: DataFrame, name: str) -> DataFrame:
    return stage(rows.withColumnRenamed(name, f"_{name}").withColumn(name, F.monotonically_increasing_id()))


def knn(queries: DataFrame, donors: DataFrame, k: int, same: bool = False) -> DataFrame:
    """``(qid, did, distance, weight)`` as :func:`nearest_rows` finds them, for ids of any type; with ``same`` the qid are the did."""
    donors = _numbered(donors.select("did", "x", "w"), "did")
    names = donors.select("did", "_did")
    if same:
        asked = queries.withColumnRenamed("qid", "_did").join(names, "_did").select(F.col("did").alias("qid"), F.col("_did").alias("_qid"), "x")
        queries = stage(asked)
    else:
        queries = _numbered(queries.select("qid", "x"), "qid")
    found = nearest_rows(queries.select("qid", "x"), donors.select("did", "x", "w"), k, same)
    named = found.join(names, "did").join(queries.select("qid", "_qid"), "qid")
    return named.select(F.col("_qid").alias("qid"), F.col("_did").alias("did"), "distance", "weight")


def nearest_rows(queries: DataFrame, donors: DataFrame, k: int, same: bool = False, leaf: int = LEAF) -> DataFrame:
    """``(qid, did, distance, weight)``: the k nearest donor rows of each query.

    Staged queries(qid, x), donors(did, x, w) with ``w`` equal rows each; ids are
    long. With ``same`` both are the same points and a row is not its own
    neighbour (its copies are). ``weight`` is how many of the k neighbours the
    donor stands for; of donors at the last distance the least ids count.

    Queries are cut into blocks of nearby rows, donors into tiles. A block gets
    the tiles that its box does not rule out, a batch at a time, and keeps the
    nearest donors so far: a task holds one block and one batch. Where boxes
    rule out nothing, all pairs are compared and every block reads all donors.
    """
    wanted = k + 1 if same else k
    donors = donors.select(F.col("did").alias("id"), "w", "x")
    first, n = donors.select(F.size("x")).first(), queries.count()
    if first is None:
        raise ValueError("no donors")
    size = min(max(ASKING[0], n // BLOCKS), ASKING[1])
    asking = tiled(queries.select(F.col("qid").alias("id"), F.lit(1).cast("long").alias("w"), "x"), first[0], size)
    tiles = tiled(donors, first[0], leaf)
    here, there = boxes(asking), boxes(tiles)
    blocks = here.count()
    pairs = box_pairs(here, there, (blocks, there.count()), _reached(wanted))
    asked = asking.select(F.col("tile").alias("a"), F.lit(0).alias("side"), "tile", "id", "w", "x")
    sent = tiles.join(pairs, F.col("tile") == F.col("b")).select("a", F.lit(1).alias("side"), "tile", "id", "w", "x")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, now = None, None
        for batch in batches:
            key, side = batch.column("a").to_numpy(), batch.column("side").to_numpy()
            ends = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(key)]
            for lo, hi in zip(ends, ends[1:]):
                if hi == lo:
                    continue
                if now is None or key[lo] != block:
                    if now is not None:
                        yield now.found(k, same)
                    block, now = key[lo], _Nearest(wanted)
                part = batch.slice(lo, hi - lo)
                now.ask(part) if side[lo] == 0 else now.meet(part)
        if now is not None:
            yield now.found(k, same)

    met = asked.unionByName(sent).repartition(2 * blocks, "a").sortWithinPartitions("a", "side", "tile")
    return met.mapInArrow(solve, "qid long, did long, distance double, weight long")


def _unique_points(points: DataFrame) -> DataFrame:
    return points.groupBy("x").agg(F.count(F.lit(1)).alias("w")).withColumn("did", F.monotonically_increasing_id())


def local_outlier_factor(df: DataFrame, key: str, columns: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """``(key, score)``: how much sparser a row's surroundings are than its neighbours'."""
    points = arrays(scaled(df, columns, [key], fill="mean"), [key])
    unique = stage(_unique_points(points))
    total = unique.agg(F.sum("w")).first()[0]
    k = min(k, max(1, total - 1))
    pairs = stage(nearest_rows(unique.select(F.col("did").alias("qid"), "x"), unique, k, same=True))
    kdist = pairs.groupBy(F.col("qid").alias("did")).agg(F.max("distance").alias("kd"))
    reach = F.greatest("distance", "kd")
    density = stage(
        pairs.join(kdist, "did")
        .groupBy("qid")
        .agg((F.sum("weight") / F.sum(F.col("weight") * reach + 1e-10 * F.col("weight"))).alias("lrd"))
    )
    around = pairs.join(density.select(F.col("qid").alias("did"), F.col("lrd").alias("other")), "did")
    lof = (
        around.groupBy("qid")
        .agg((F.sum(F.col("weight") * F.col("other")) / F.sum("weight")).alias("mean"))
        .join(density, "qid")
        .select("qid", (F.col("mean") / F.col("lrd")).alias("score"))
    )
    scored = unique.select("x", F.col("did").alias("qid")).join(lof, "qid").select("x", "score")
    return points.join(scored, "x").select(key, "score")


# --- imputation by neighbours with gaps of their own ------------------------------------------


def _least_mean(values: np.ndarray, must: np.ndarray, may: np.ndarray, sign: int = 1) -> np.ndarray:
    """Per row: the least (``sign`` -1: largest) mean of ``values`` over the sets of columns with all of ``must`` and some of ``may``.

    Infinite where no column is left.
    """
    v = sign * values
    free = np.sort(np.where(may & ~must, v, np.inf), axis=1)
    total = np.concatenate([np.where(must, v, 0).sum(axis=1, keepdims=True), free], axis=1).cumsum(axis=1)
    size = must.sum(axis=1, keepdims=True) + np.arange(v.shape[1] + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        means = np.where(size > 0, total / size, np.inf)
    return sign * np.where(np.isnan(means), np.inf, means).min(axis=1)


def _sets(q: Boxes, i: int, d: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """Columns that all rows of both boxes share, and those that some may share."""
    must = (q.has[i] == q.w[i]) & (d.has == d.w[:, None])
    may = (q.has[i] > 0) & (d.has > 0)
    return must, may


def _homes(k: int):
    """Donor tiles that hold ``k`` donors for every column a tile lacks, near ones by the boxes."""

    def choose(q: Boxes, d: Boxes) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        for i in range(len(q.tile)):
            must, may = _sets(q, i, d)
            order = np.argsort(_least_mean(q.spans(i, d), must, may, -1), kind="stable")
            order = order[may[order].any(axis=1)]
            chosen = np.zeros(len(d.tile), bool)
            for c in np.flatnonzero(q.has[i] < q.w[i]):
                donors = order[d.has[order, c] > 0]
                enough = np.searchsorted(np.cumsum(d.has[donors, c]), k) + 1
                chosen[donors[:enough]] = True
            b.append(np.flatnonzero(chosen))
            a.append(np.full(len(b[-1]), i))
        return np.concatenate(a), np.concatenate(b)

    return choose


def _visits(width: int):
    """Donor tiles that may hold a donor within the limit of some column that a tile lacks."""

    def choose(q: Boxes, d: Boxes) -> tuple[np.ndarray, np.ndarray]:
        a, b = [np.zeros(0, int)], [np.zeros(0, int)]
        limits = rows_of(q.table.column("limits"))
        for i in range(len(q.tile)):
            must, may = _sets(q, i, d)
            least = width * _least_mean(q.gaps(i, d), must, may)
            wanted = (q.has[i] < q.w[i]) & (d.has > 0) & (least[:, None] <= limits[i] * (1 + 1e-9))
            b.append(np.flatnonzero(wanted.any(axis=1) & may.any(axis=1)))
            a.append(np.full(len(b[-1]), i))
        return np.concatenate(a), np.concatenate(b)

    return choose


_NAN = "double('NaN')"
_FOUND = "id long, c int, far double, n long, total double"


#: Pairs of gap patterns, of some rows and some donors, that are measured one by one.
PATTERNS = 16

_Hits = tuple[np.ndarray, ...]


def _trimmed(hits: list[_Hits], k: int) -> _Hits:
    """Of (row, column, distance, donors, sum of their values): one line a distance, as far as the nearest ``k`` donors of a row and column reach; and how many are before."""
    i, c, far, n, total = (np.concatenate(x) for x in zip(*hits))
    order = np.lexsort((far, c, i))
    i, c, far, n, total = (x[order] for x in (i, c, far, n, total))
    fresh = np.ones(len(i), bool)
    fresh[1:] = (i[1:] != i[:-1]) | (c[1:] != c[:-1])
    heads = fresh.copy()
    heads[1:] |= far[1:] != far[:-1]
    heads = np.flatnonzero(heads)
    if not len(heads):
        return i, c, far, n, total, n
    n, total = np.add.reduceat(n, heads), np.add.reduceat(total, heads)
    i, c, far, first = i[heads], c[heads], far[heads], np.flatnonzero(fresh[heads])
    before = np.cumsum(n) - n
    before -= np.repeat(before[first], np.diff(np.concatenate([first, [len(i)]])))
    keep = before < k
    return tuple(x[keep] for x in (i, c, far, n, total, before))


def _patterns(have: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The gap patterns of some rows, each with its rows."""
    if (have == have[:1]).all():
        return [(have[0], np.arange(len(have)))] if len(have) else []
    kinds, of = np.unique(have, axis=0, return_inverse=True)
    return [(kind, np.flatnonzero(of.ravel() == m)) for m, kind in enumerate(kinds)]


def _alike(q: np.ndarray, limits: np.ndarray, mine: tuple, y: np.ndarray, w: np.ndarray, theirs: tuple, k: int, width: int, block: int = 128) -> Iterator[_Hits]:
    """:func:`_hits` of rows of one gap pattern among donors of one."""
    (have, rows), (there, donors) = mine, theirs
    both, wanted = np.flatnonzero(have & there), np.flatnonzero(~have & there)
    if not len(both) or not len(wanted):
        return
    scale = len(both) / width
    held = y[np.ix_(donors, both)]
    own = q[np.ix_(rows, both)]
    reach = limits[np.ix_(rows, wanted)].max(axis=1) * (1 + 1e-9) * scale
    able = np.flatnonzero((np.maximum(0, np.maximum(held.min(axis=0) - own, own - held.max(axis=0))) ** 2).sum(axis=1) <= reach * (1 + 1e-9))
    middle = held.mean(axis=0)
    v = held - middle
    double, b = (-2 * v).T, (v * v).sum(axis=1)
    for lo in range(0, len(able), block):
        at = able[lo : lo + block]
        u = own[at] - middle
        a = (u * u).sum(axis=1)
        loose = 1e-12 * (a + b.max())
        # Squared differences less the row's own part: products tell who is near, the differences of those decide.
        near = u @ double
        near += b
        top = reach[at]
        if len(donors) > k and not np.isfinite(top).all():
            top = np.minimum(top, np.partition(near, k - 1, axis=1)[:, k - 1] + a + loose)
        i, j = np.divmod(np.flatnonzero(near <= (top - a + loose)[:, None]), len(donors))
        if not len(i):
            continue
        i, j = rows[at[i]], donors[j]
        shared = have & there
        far = width * (np.where(shared, q[i] - y[j], 0) ** 2).sum(axis=1) / len(both)
        for c in wanted:
            on = far <= limits[i, c]
            yield i[on], np.full(int(on.sum()), c, np.int32), far[on], w[j[on]], w[j[on]] * y[j[on], c]


def _mixed(q: np.ndarray, limits: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, width: int, block: int = 256) -> Iterator[_Hits]:
    """:func:`_hits` of rows and donors of any gap patterns."""
    middle = np.nan_to_num(np.nanmean(np.concatenate([y, q]), axis=0))
    have, there = ~np.isnan(q), ~np.isnan(y)
    u, v = np.where(have, q - middle, 0), np.where(there, y - middle, 0)
    for lo in range(0, len(q), block):
        own = slice(lo, lo + block)
        shared = have[own].astype(float) @ there.T
        size = (u[own] ** 2) @ there.T + have[own] @ (v**2).T
        with np.errstate(divide="ignore", invalid="ignore"):
            # Products tell who is near; the differences of those decide.
            near = np.where(shared > 0, width * np.maximum(size - 2 * u[own] @ v.T, 0) / shared, np.inf)
            slack = np.where(shared > 0, width * 1e-12 * size / shared, 0)
        for c in np.flatnonzero(~have[own].all(axis=0)):
            mine, donors = np.flatnonzero(~have[own][:, c]), np.flatnonzero(there[:, c])
            if not len(donors):
                continue
            d, loose = near[np.ix_(mine, donors)], slack[np.ix_(mine, donors)]
            top = np.minimum(np.partition(d + loose, k - 1, axis=1)[:, k - 1] if len(donors) >= k else np.inf, limits[own][mine, c] * (1 + 1e-9))
            i, j = np.nonzero((d - loose <= top[:, None]) & np.isfinite(d))
            if not len(i):
                continue
            i, j = mine[i] + lo, donors[j]
            both = have[i] & there[j]
            far = width * (np.where(both, q[i] - y[j], 0) ** 2).sum(axis=1) / both.sum(axis=1)
            on = far <= limits[i, c]
            yield i[on], np.full(int(on.sum()), c, np.int32), far[on], w[j[on]], w[j[on]] * y[j[on], c]


def _hits(q: np.ndarray, limits: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, width: int) -> list[_Hits]:
    """(row, column, distance, donors, sum of their values) of donors ``y`` for the gaps of the rows ``q``.

    The nearest ``k`` donors of each gap are among them, others may be, and none
    is beyond the gap's limit.
    """
    mine, theirs = _patterns(~np.isnan(q)), _patterns(~np.isnan(y))
    if len(mine) * len(theirs) > PATTERNS:
        found = _mixed(q, limits, y, w, k, width)
    else:
        found = (h for a in mine for b in theirs for h in _alike(q, limits, a, y, w, b, k, width))
    none = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
    return [none, *found]


def _found(ids: np.ndarray, hits: _Hits) -> dict[str, pa.Array]:
    i, *rest = hits[:5]
    return dict(zip(("id", "c", "far", "n", "total"), map(pa.array, (ids[i], *rest))))


def _donors(k: int, width: int):
    """For rows with gaps and a tile of donors: per row, missing column and distance, how many donors and the sum of their values.

    Only the distances that the nearest ``k`` donors of the tile have.
    """

    def find(rows: pa.Table, held: pa.Table) -> pa.Table:
        q, y = rows_of(rows.column("x")), rows_of(held.column("x"))
        hits = _hits(q, np.full(q.shape, np.inf), y, held.column("w").to_numpy(), k, width)
        return pa.table(_found(rows.column("id").to_numpy(), _trimmed(hits, k)))

    return find


def _streamed(k: int, width: int):
    """As :func:`_donors` for blocks of rows that come before their donors: each batch of donors lowers the block's limits."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, ids, q, limits, best = None, [], None, None, None, []
        for batch in batches:
            key, side = batch.column("a").to_numpy(), batch.column("side").to_numpy()
            ends = [0, *(np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(key)]
            for lo, hi in zip(ends, ends[1:]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if key[lo] != block:
                    if best:
                        yield pa.RecordBatch.from_pydict(_found(ids, best[0]))
                    block, waiting, q, best = key[lo], [], None, []
                if side[lo] == 0:
                    waiting.append(part)
                    continue
                if q is None:
                    ids = np.concatenate([b.column("id").to_numpy() for b in waiting])
                    q, limits = (np.concatenate([rows_of(b.column(c)) for b in waiting]) for c in ("x", "limits"))
                hits = _hits(q, limits, rows_of(part.column("x")), part.column("w").to_numpy(), k, width)
                if sum(len(h[0]) for h in hits):
                    *kept, before = _trimmed([*best, *hits], k)
                    best = [tuple(kept)]
                    full = before + kept[3] >= k
                    i, c = kept[0][full], kept[1][full]
                    limits[i, c] = np.minimum(limits[i, c], kept[2][full])
        if best:
            yield pa.RecordBatch.from_pydict(_found(ids, best[0]))

    return find


def _places(found: DataFrame, k: int) -> DataFrame:
    """The distances of each row and column with how many of the ``k`` places they fill (``used``)."""
    each = found.groupBy("id", "c", "far").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    order = Window.partitionBy("id", "c").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(order), F.lit(0))
    return each.withColumn("used", F.least("n", F.lit(k) - before)).filter("used > 0")


def gap_neighbours(points: DataFrame, k: int, leaf: int = LEAF) -> DataFrame:
    """``(id, c, value)``: for each gap of ``points`` (id, w, x) the mean of column ``c`` of the k nearest rows that have it.

    The squared distance of two rows is the mean squared difference over the
    columns both have, times all columns; rows without a common column are no
    neighbours. Rows at the same distance share the last places equally, so the
    result depends on no order. A gap that nobody can fill has no row.

    Rows with gaps ask tiles of donors. What a tile can hold at best follows from
    its box and from the columns all or some of its rows have, so any mix of gap
    patterns is one search. A first round visits near tiles with ``k`` donors and
    gives each gap a limit. In a second one a block of rows reads every other
    tile that may beat it, a batch at a time, and its limits fall as it reads: a
    task holds one block and one batch. Where boxes rule out nothing, all pairs
    are compared and every block reads all donors.
    """
    gappy = stage(points.filter(F.exists("x", lambda v: F.isnan(v))))
    first, n = gappy.select(F.size("x")).first(), gappy.count()
    if first is None:
        return gappy.select("id", F.lit(0).alias("c"), F.lit(0.0).alias("value"))
    width = first[0]
    donors = tiled(points, width, leaf)
    size = min(max(ASKING[0], n // BLOCKS), ASKING[1])
    asking = tiled(gappy, width, size)
    there, here = boxes(donors), boxes(asking)
    counts = here.count(), there.count()
    homes = box_pairs(here, there, counts, _homes(k))
    first = stage(compare(asking, donors, homes, _donors(k, width), _FOUND))

    # A gap's limit is the distance of its k-th donor so far.
    limits = _places(first, k).groupBy("id", "c").agg(F.max("far").alias("far"), F.sum("used").alias("used"))
    limits = limits.select("id", "c", F.when(F.col("used") >= k, F.col("far")).otherwise(float("inf")).alias("far"))
    by_row = limits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "far"))).alias("m"))
    of = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda c: F.coalesce(F.element_at("m", c), F.lit(float("inf"))))
    # A column that a row has asks for nothing.
    asked = F.transform(F.arrays_zip("x", of.alias("far")), lambda p: F.when(F.isnan(p["x"]), p["far"]).otherwise(-1.0))
    asking = stage(asking.join(by_row, "id", "left").select("tile", "id", "w", "x", asked.alias("limits")))
    whole = asking.select("tile", F.posexplode("limits").alias("c", "far")).groupBy("tile", "c").agg(F.max("far").alias("far"))
    whole = whole.groupBy("tile").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "far"))), lambda p: p["far"]).alias("limits"))
    rest = stage(box_pairs(here.join(whole, "tile"), there, counts, _visits(width)).join(homes, ["a", "b"], "left_anti"))
    blocks = asking.select(F.col("tile").alias("a"), F.lit(0).alias("side"), "tile", "id", "w", "x", "limits")
    sent = donors.join(rest, F.col("tile") == F.col("b")).select("a", F.lit(1).alias("side"), "tile", "id", "w", "x", F.lit(None).cast("array<double>").alias("limits"))
    met = blocks.unionByName(sent).repartition(2 * max(1, counts[0]), "a").sortWithinPartitions("a", "side", "tile")
    found = first.unionByName(met.mapInArrow(_streamed(k, width), _FOUND))
    value = F.sum(F.col("used") * F.col("total") / F.col("n")) / F.sum("used")
    return _places(found, k).groupBy("id", "c").agg(value.alias("value"))


def knn_impute(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, leaf: int = LEAF) -> DataFrame:
    """Fill numeric gaps with the mean of the k nearest rows that have a value there, however gappy themselves.

    Distances and ties as in :func:`gap_neighbours`. A gap of a row that shares
    no column with any donor gets the column's mean; a column without a value
    stays as it is. Equal rows act as one of their weight. The search runs under
    names of its own, so any column name is allowed.
    """
    own = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    filled = _knn_fill(df.toDF(*own.values()), [own[c] for c in numeric_columns(df, columns)], k, leaf)
    return filled.select(*own.values()).toDF(*own)


def _knn_fill(df: DataFrame, numbers: Sequence[str], k: int, leaf: int) -> DataFrame:
    if not numbers:
        return df
    # One string a column: names are the search's own, and expressions built call by call take longer than they run.
    x = F.expr(f"array({', '.join(f'coalesce(double({c}), {_NAN})' for c in numbers)})")
    base = stage(df.withColumn("_x", x))
    unique = base.groupBy(F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("w")).withColumn("id", F.monotonically_increasing_id())
    unique = stage(unique)
    values = gap_neighbours(unique, k, leaf).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "value"))).alias("_m"))
    # Of each different row with gaps one line; hot rows are split at run time.
    fills = unique.filter(F.exists("x", lambda v: F.isnan(v))).join(values, "id", "left").select(F.col("x").alias("_x"), "_m")
    means = unique.selectExpr(*[f"sum(nullif(x[{i}], {_NAN}) * w) / sum(if(isnan(x[{i}]), null, w)) as m{i}" for i in range(len(numbers))])
    gappy = F.exists("_x", lambda v: F.isnan(v))
    joined = attach(base.filter(gappy).join(fills, "_x", "left"), means)
    place = {c: i for i, c in enumerate(numbers)}
    filled = joined.selectExpr(*[f"coalesce(nullif(_x[{place[c]}], {_NAN}), _m[{place[c]}], _s.m{place[c]}) as {c}" if c in place else c for c in df.columns])
    whole = base.filter(~gappy).selectExpr(*[f"_x[{place[c]}] as {c}" if c in place else c for c in df.columns])
    return filled.unionByName(whole)
