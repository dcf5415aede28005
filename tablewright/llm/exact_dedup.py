"""Exact deduplication by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes says so, so equal texts
(and equal passages) give equal chunks. Chunks are deduplicated to verified
identifiers: every chunk's bytes travel once, and a digest that turns out to
stand for different bytes gets the bytes themselves into its identifier. From
then on a document is its ordered list of identifiers; equal lists are equal
texts, and no document moves again.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import flat_bytes, group_join, mixed, release, slices, staged

MIN_CHUNK, MAX_CHUNK, MASK_BITS = 512, 8192, 10

_GEAR = (mixed(np.arange(256, dtype=np.uint64), 7) >> np.uint64(32)).astype(np.uint32)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cut_points(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last 32 bytes asks for a cut."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h = longer
    return np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1


def _chunk_ends(points: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of one text: cuts at least MIN_CHUNK and at most MAX_CHUNK apart."""
    out, at = [], start
    lo, hi = np.searchsorted(points, (start + 1, end))
    mine, k = points[lo:hi].tolist(), 0
    while end - at > MIN_CHUNK:
        while k < len(mine) and mine[k] < at + MIN_CHUNK:
            k += 1
        at = min(mine[k] if k < len(mine) else end, at + MAX_CHUNK, end)
        out.append(at)
    if at < end:
        out.append(end)
    return out


def _cutter(with_data: bool, digest_bytes: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            data, offsets = flat_bytes(batch.column(1))
            data = _LOWER[data]
            points, raw = _cut_points(data), data.tobytes()
            recipes, shas, digests, chunks = [], [], [], []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                shas.append(hashlib.sha256(raw[start:end]).hexdigest())
                at, recipe = start, []
                for stop in _chunk_ends(points, start, end):
                    digest = hashlib.blake2b(raw[at:stop], digest_size=digest_bytes).digest()
                    recipe.append(digest)
                    if with_data:
                        digests.append(digest)
                        chunks.append(raw[at:stop])
                    at = stop
                recipes.append(recipe)
            if with_data:
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(chunks, pa.binary())], ["digest", "data"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(shas, pa.string()), pa.array([struct.pack("<Q", e - s) + b"".join(r) for r, s, e in zip(recipes, offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())],
                    ["doc_id", "text_sha256", "recipe"],
                )

    return cut


def _exact_cutter(bad: frozenset[bytes], digest_bytes: int):
    """Recipes in which a digest that stands for several chunks is followed by the chunk's bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            data, offsets = flat_bytes(batch.column(1))
            data = _LOWER[data]
            points, raw = _cut_points(data), data.tobytes()
            shas, recipes = [], []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                at, recipe = start, [struct.pack("<Q", end - start)]
                for stop in _chunk_ends(points, start, end):
                    chunk = raw[at:stop]
                    digest = hashlib.blake2b(chunk, digest_size=digest_bytes).digest()
                    recipe.append(digest + struct.pack("<I", len(chunk)) + chunk if digest in bad else digest)
                    at = stop
                shas.append(hashlib.sha256(raw[start:end]).hexdigest())
                recipes.append(b"".join(recipe))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return cut


def exact_duplicates(docs: DataFrame, digest_bytes: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    row with the largest doc_id stays. Null texts count as empty, and all empty
    texts are equal. A null doc_id is below every other; of rows that repeat
    both doc_id and text one stays. Other columns are ignored; an empty table
    gives an empty result.

    Two digests of different chunks collide about never at 16 bytes; then those
    chunks' identifiers hold the bytes. ``digest_bytes`` is there for tests.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.col("text").cast("binary").alias("_t"))
    chunks = source.mapInArrow(_cutter(True, digest_bytes), "digest binary, data binary")
    # Each digest's different byte strings: one, unless the digest fails.
    failed = chunks.groupBy("digest").agg(F.collect_set("data").alias("found")).filter(F.size("found") > 1)
    # Collisions only, not the documents' digests.
    bad = frozenset(bytes(r[0]) for r in failed.select("digest").collect())
    release(spark)
    cutter = _exact_cutter(bad, digest_bytes) if bad else _cutter(False, digest_bytes)
    recipes = staged(source.mapInArrow(cutter, f"doc_id {id_type}, text_sha256 string, recipe binary"), "recipes")
    grouped = group_join(
        recipes,
        "recipe",
        "doc_id",
        keep_id=(F.max("doc_id"), F.max),
        group_size=(F.count(F.lit(1)), F.sum),
    )
    # Rows that repeat the kept doc_id stand next to each other; the first of them stays.
    same = Window.partitionBy("recipe", "doc_id").orderBy("text_sha256")
    return grouped.withColumn("_n", F.row_number().over(same)).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, all columns as they were."""
    kept = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_llm_id"), F.col("text_sha256").alias("_llm_sha"))
    marked = docs.withColumn("_llm_sha_", F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256))
    same = marked["doc_id"].eqNullSafe(kept["_llm_id"]) & (marked["_llm_sha_"] == kept["_llm_sha"])
    rows = marked.join(kept, same, "left_semi")
    return rows.dropDuplicates(["doc_id", "_llm_sha_"]).drop("_llm_sha_")
