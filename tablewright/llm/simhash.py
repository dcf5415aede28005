"""SimHash near-duplicates, found through pivot distance tables.

Each text gets a 64-bit fingerprint; equal fingerprints collapse into one. For
every fingerprint the workers tabulate its Hamming distances to many reference
fingerprints. By the triangle inequality two fingerprints within the radius
differ by no more than the radius in any of these distances, so a pair whose
largest coordinate difference is greater is discarded; survivors are verified
bit by bit. So that no stage looks at all pairs, fingerprints meet only under
keys of three of seven bit blocks: two fingerprints that differ in four bits or
fewer agree on three blocks at least, so every link is met under some key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import components, group_join, mixed, release, slices, spread_join, staged

SHINGLE, SEED, RADIUS, N_PIVOTS = 4, 42, 4, 24

#: Bit blocks (first bit, width) and the triples of them that serve as keys.
BLOCKS = [(0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10)]
TRIPLES = list(itertools.combinations(BLOCKS, len(BLOCKS) - RADIUS))

#: Runs of one key above this length are compared tile by tile.
LONG_RUN, TILE = 64, 1024

PIVOTS = mixed(np.arange(N_PIVOTS, dtype=np.uint64), 99)

# For a byte: its eight bits as eight one-byte counters.
_SPREAD = np.array([sum(((v >> bit) & 1) << (8 * bit) for bit in range(8)) for v in range(256)], dtype=np.uint64)


def bit_majority(hashes: np.ndarray) -> int:
    """The fingerprint whose bit is 1 where it is set in over half of ``hashes``."""
    n = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 255 * 256):
        lanes = _SPREAD[hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)  # counters hold 255
        counts += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int((counts * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - SHINGLE]]).tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    hash64 = xxhash.xxh64_intdigest
    return bit_majority(np.array([hash64(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_t"):
        found = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_t")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _keys(fp):
    """The long keys of one fingerprint: which triple, and its bits."""
    part = lambda first, width: F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))
    out = []
    for i, triple in enumerate(TRIPLES):
        key = F.lit(i).cast("long")
        for first, width in triple:
            key = F.shiftleft(key, width).bitwiseOR(part(first, width))
        out.append(key)
    return F.array(*out)


def _verified(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no pivot discards and whose fingerprints are within the radius."""
    for row in table:
        near = np.abs(row[i] - row[j]) <= radius
        i, j = i[near], j[near]
    near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
    return i[near], j[near]


def _run_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Component label of each row by the links inside runs of equal, sorted keys."""
    n = len(fps)
    table = np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in PIVOTS])
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lengths = np.diff(np.concatenate([heads, [n]]))
    left = np.repeat(heads + lengths, lengths) - np.arange(n)  # rows up to the run's end
    long_run = np.repeat(lengths > LONG_RUN, lengths)
    a, b = [], []
    i, step = np.flatnonzero(~long_run & (left > 1)), 1
    while len(i):
        x, y = _verified(fps, table, i, i + step, radius)
        a.append(x)
        b.append(y)
        step += 1
        i = i[left[i] > step]
    label = components(n, np.concatenate(a) if a else np.zeros(0, int), np.concatenate(b) if b else np.zeros(0, int))
    for head, length in zip(heads[lengths > LONG_RUN].tolist(), lengths[lengths > LONG_RUN].tolist()):
        # Sorted by the first pivot's distance, only tiles within the radius of each other can hold links.
        order = head + np.argsort(table[0][head : head + length], kind="stable")
        run_fps, run_table, mine = fps[order], table[:, order], np.arange(length)
        d0 = run_table[0]
        for s in range(0, length, TILE):
            end = min(s + TILE, length)
            stop = int(np.searchsorted(d0, int(d0[end - 1]) + radius, side="right"))
            for c in range(s, stop, TILE):
                x, y = np.meshgrid(np.arange(s, end), np.arange(c, min(c + TILE, stop)), indexing="ij")
                open_ = (x < y) & (mine[x] != mine[y])
                x, y = x[open_], y[open_]
                if len(x):
                    x, y = _verified(run_fps, run_table, x, y, radius)
                    merged = components(length, mine[x], mine[y])
                    mine = merged[mine]
        label[order] = order[mine]
    return label


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            label = _run_links(keys, fps.view(np.uint64), radius)
            linked = label != np.arange(len(fps))
            pairs = np.unique(np.stack([fps[linked], fps[label[linked]]], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
            if len(keys) < 100_000:
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            if whole:
                yield found(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield found(keys, fps)

    return link


def link_components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in ``links`` (a, b longs).

    Alternates large-star and small-star steps, each a minimum per node and one
    spread join, until the links no longer change; every round is written out.
    """

    def low(both: DataFrame) -> DataFrame:
        return group_join(both, "u", "v", m=(F.min(F.least("u", "v")), F.min))

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = mark(now)
    while seen[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        large = staged(low(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = low(large)
        down = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        now = staged(down.filter("a <> b").distinct(), "small")
        if (then := mark(now)) == seen:
            break
        seen = then
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _placed(rows: DataFrame, radius: int) -> DataFrame:
    """fp, first (its smallest doc_id) and root (its component's smallest fingerprint) of every fingerprint in ``rows``."""
    if radius > RADIUS:
        raise ValueError(f"the keys find links of {RADIUS} bits at most")
    spark = rows.sparkSession
    each = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    keyed = each.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_linker(radius), "a long, b long")
    roots = link_components(links)
    release(spark)
    return staged(
        each.join(roots, each["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")),
        "placed",
    )


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id.

    The fingerprint is the bit majority of the XXH64 (seed 42) of all 4-word
    shingles of the lower-cased text, as 16 hex digits; shorter texts are one
    shingle, texts without words (null and empty ones too) have fingerprint
    zero and are linked like any other. Fingerprints within ``radius`` (4 at
    most) bits link; component_id is the smallest doc_id reachable, and null
    doc_ids are passed over unless there is no other. Rows that repeat a doc_id
    are rows of their own. Other columns are ignored.
    """
    rows = staged(fingerprints(docs), "fingerprints")
    placed = _placed(rows, radius)
    named = group_join(placed, "root", "fp", component_id=(F.min("first"), F.min)).select("fp", "component_id")
    out = spread_join(rows, "fp", "doc_id", named)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """One row of each component: of those with its smallest doc_id, the one whose text has the least hash.

    Null doc_ids are passed over unless a component has no other. Rows that
    share a doc_id (or have none) and lie in different components all stay for
    theirs; rows that repeat both doc_id and text are one.
    """
    numbered = staged(docs.withColumn("_llm_row", F.monotonically_increasing_id()), "numbered")
    named = numbered.select(F.col("_llm_row").alias("doc_id"), "text")
    rows = staged(fingerprints(named).withColumnRenamed("doc_id", "_row"), "fingerprints")
    keys = numbered.select(
        F.col("_llm_row").alias("_row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256).alias("sha"), F.col("_llm_row").alias("row")).alias("_k")
    )
    ranked = staged(rows.join(keys, "_row"), "ranked")
    placed = _placed(ranked.select("fp", F.col("_k")["doc_id"].alias("doc_id")), RADIUS)
    # The best row of each fingerprint, then of each component; minima combine, so a hot one is no single task.
    best = ranked.groupBy("fp").agg(F.min("_k").alias("_k")).join(placed, "fp").groupBy("root").agg(F.min("_k").alias("_k"))
    kept = best.select(F.col("_k")["row"].alias("_llm_id"))
    return numbered.join(kept, numbered["_llm_row"] == kept["_llm_id"], "left_semi").select(*[f"`{c}`" for c in docs.columns])
