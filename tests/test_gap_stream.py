"""Gaps filled from donors that are read as a stream, against plain searches over all rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.operators import neighbours
from tablewright.session import stage

NAN = float("nan")


def points(seed, n, patterns, d=6):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) * 2) if seed % 2 else rng.normal(size=(n, d))
    kinds = rng.random((patterns, d)) < 0.3
    kinds[0] = False
    x[kinds[rng.integers(0, patterns, n)]] = NAN
    return x, rng.integers(1, 4, n)


def plain(q, y, w, k):
    """{(row, column): mean of the k nearest donors, the last places shared}"""
    out = {}
    for i, row in enumerate(q):
        both = ~np.isnan(row) & ~np.isnan(y)
        size = both.sum(axis=1)
        far = np.where(both, row - y, 0) ** 2
        far = np.where(size > 0, q.shape[1] * far.sum(axis=1) / np.maximum(size, 1), np.inf)
        for c in np.flatnonzero(np.isnan(row)):
            able = np.isfinite(far) & ~np.isnan(y[:, c])
            left, total, places = k, 0.0, 0.0
            for d in np.unique(far[able]):
                at = able & (far == d)
                used = min(left, w[at].sum())
                total, places, left = total + used * (w[at] * y[at, c]).sum() / w[at].sum(), places + used, left - used
                if not left:
                    break
            if places:
                out[i, int(c)] = total / places
    return out


def mean(found, k):
    out = {}
    for i, c, far, n, total in sorted(zip(*[x.tolist() for x in found[:5]])):
        places, value = out.get((i, c), (0, 0.0))
        used = min(k - places, n)
        out[i, c] = (places + used, value + used * total / n) if used > 0 else (places, value)
    return {key: v / p for key, (p, v) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("patterns", [2, 3, 40])
def test_a_stream_of_donors_gives_the_nearest(seed, patterns):
    """Blocks of one, of few and of many gap patterns; batches that end inside a block, and rows without donors."""
    k, columns = 3, ["a", "side", "tile", "id", "w", "x", "limits"]
    batches, expected = [], {}
    for a in (5, 9):
        q, _ = points(seed + 10 * a, 50, patterns)
        y, w = points(seed + 10 * a + 2, 300, patterns)
        limits = np.where(np.isnan(q), np.inf, -1.0)
        rows = [[a, 0, a, 1000 * a + i, 1, x.tolist(), m.tolist()] for i, (x, m) in enumerate(zip(q, limits))]
        rows += [[a, 1, j // 40, j, int(w[j]), y[j].tolist(), None] for j in range(len(y))]
        expected |= {(1000 * a + i, c): v for (i, c), v in plain(q, y, w, k).items()}
        batches += rows
    batches.append([11, 0, 11, 11_000, 1, [NAN, *[0.0] * 5], [np.inf, *[-1.0] * 5]])
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
    cut = [batches[lo : lo + 37] for lo in range(0, len(batches), 37)]
    sent = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], columns) for part in cut]
    table = pa.Table.from_batches(list(neighbours._streamed(k, 6)(iter(sent))))
    got = mean([table.column(c).to_numpy() for c in ("id", "c", "far", "n", "total")], k)
    assert got.keys() == expected.keys()
    assert all(got[key] == pytest.approx(v, rel=1e-9, abs=1e-12) for key, v in expected.items())


@pytest.mark.parametrize("patterns", [3, 40])
def test_limits_keep_all_that_is_within(patterns):
    q, _ = points(3, 60, patterns)
    y, w = points(4, 200, patterns)
    free = neighbours._trimmed(neighbours._hits(q, np.full(q.shape, np.inf), y, w, 4, 6), 4)
    limits = np.where(np.isnan(q), 5.0, -1.0)
    bound = neighbours._trimmed(neighbours._hits(q, limits, y, w, 4, 6), 4)
    within = free[2] <= 5.0
    assert all(np.array_equal(a[within], b) or np.allclose(a[within], b) for a, b in zip(free[:5], bound[:5]))


def test_blocks_and_tiles_give_what_one_table_gives(spark, monkeypatch):
    """Blocks of a few rows, tiles of a few donors: nothing is lost between them, and a table without gaps asks for nothing."""
    monkeypatch.setattr(neighbours, "ASKING", (16, 16))
    x, w = points(6, 240, 4)
    df = stage(spark.createDataFrame([(i, int(n), v.tolist()) for i, (n, v) in enumerate(zip(w, x))], "id long, w long, x array<double>").repartition(5))
    got = {(r["id"], r["c"]): r["value"] for r in neighbours.gap_neighbours(df, 3, leaf=24).collect()}
    expected = plain(x, x, w, 3)
    assert got.keys() == expected.keys()
    assert all(got[key] == pytest.approx(v, rel=1e-9, abs=1e-12) for key, v in expected.items())
    assert neighbours.gap_neighbours(stage(df.filter(~F.exists("x", lambda v: F.isnan(v)))), 3).count() == 0
