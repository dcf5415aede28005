"""Helpers the training-data operators share: staging, skew-proof joins, Arrow batches."""

from __future__ import annotations

import gc
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import fresh_folder

#: Rows of one key are dealt over so many sub-keys.
SALTS = 64

#: Workers look at so many bytes of text at a time.
SLICE_BYTES = 8 << 20

#: The six white-space characters of ASCII; words are what stands between them.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the folder all executors share and go on from the files.

    It cuts lineage: a lost executor costs its own tasks only, and every later
    reader sees the same rows.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, f"llm-{purpose}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark's context cleaner drop shuffle files that no plan needs any more.

    It acts when the driver's JVM collects garbage, which a quiet driver seldom
    does; between the stages of a long operator that would keep every shuffle.
    Python's own references to finished plans go first, as they keep the JVM's.
    The last job is held by events that are still on their way, so another small
    job follows it, and the garbage is collected once more a little later.
    """
    spark.range(1).count()
    for pause in (0.3, 0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def salt(*spread: str | Column) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")


def spread_join(rows: DataFrame, key: str, spread: str | Column, values: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns that ``values`` has for their ``key``.

    ``values`` has one row a key and keys are not null. Rows of one key are
    dealt over ``SALTS`` sub-keys, and each sub-key that occurs gets its copy of
    the value, so a key with a third of all rows is no single task. ``rows`` is
    read twice: stage it first.
    """
    salted = rows.withColumn("_salt", salt(spread))
    present = salted.groupBy(key, "_salt").agg(F.lit(True).alias("_p"))
    copies = present.join(values, key).drop("_p")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def group_join(rows: DataFrame, key: str, spread: str | Column, **aggregates: tuple[Column, Callable[[str], Column]]) -> DataFrame:
    """``rows`` with aggregates of their ``key``'s group; each is (partial, merge).

    Partials are taken per sub-key, merged per key, and go back by the sub-key.
    """
    salted = rows.withColumn("_salt", salt(spread))
    part = salted.groupBy(key, "_salt").agg(*[p.alias(n) for n, (p, _) in aggregates.items()])
    total = part.groupBy(key).agg(*[m(n).alias(n) for n, (_, m) in aggregates.items()])
    return salted.join(part.select(key, "_salt").join(total, key), [key, "_salt"]).drop("_salt")


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``text``; one long row stays whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if not column.nbytes > limit:
            yield batch
            continue
        sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], dtype=np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and the rows' offsets; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: well-mixed values of unsigned longs (splitmix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a-b: the smallest node of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if (before == label).all():
            break
    return label


def word_lists(text: bytes, piece: int = 4 << 20) -> Iterator[list[bytes]]:
    """The words of ``text`` between ASCII white space, in lists from about ``piece`` bytes each; words stay whole."""
    start = 0
    while start < len(text):
        gap = _WHITE.search(text, start + piece)
        stop = gap.start() if gap else len(text)
        yield text[start:stop].split()
        start = stop
