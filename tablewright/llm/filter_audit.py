"""Which filter removes what in which order: an audit by min-plus removal ranks.

A document is a mask of the filters that it fails. The mask matrix (0 where a
mask fails a filter, beyond the last step where it does not) times the position
matrix (the step at which an order applies a filter, its inverse permutation),
with sums for products and minima for sums, is the step at which every order
removes every mask. Documents of one part and mask are one weighted row, so the
product has 2^filters rows at any size of the corpus, and every count of the
audit is a scatter of those weights by removal step.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import group_join, slices, staged, word_lists

FILTERS = "ABCDE"

_CAPITALS = bytes(range(65, 91))
_CONTINUATION = bytes(range(0x80, 0xC0))  # of UTF-8; every other byte begins a code point
_MARKS = re.compile(rb"[#$%&*|]")

_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the failures of A to D that a text shows by itself."""
    n, seen = 0, set()
    for words in word_lists(text):
        n += len(words)
        seen.update(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUATION))
    fails = (n < 200, 100 * len(seen) < 50 * n, 100 * capitals > 2 * points, _MARKS.search(text) is not None)
    return sum(1 << k for k, bad in enumerate(fails) if bad)


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_t"):
        masks, digests = [], []
        for value in batch.column(2):
            text = value.as_py() or b""
            masks.append(text_mask(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"]
        )


def document_masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row of ``docs``; bit k of the mask is the failure of filter k.

    A: under 200 words. B: under half of the words are different. C: over 2 % of
    the code points are capitals A-Z. D: holds one of ``#$%&*|``. E: a smaller
    doc_id has the same text (by SHA-256). A null text is empty, a null source is
    the part ''. A null doc_id is neither smaller nor larger than another, so its
    row never fails E; rows that repeat doc_id and text fail it alike.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("_t"))
    rows = staged(source.mapInArrow(_masks, f"doc_id {kind}, part string, mask int, digest binary"), "masks")
    # The copies of one text are dealt by doc_id; minima combine.
    first = group_join(rows, "digest", "doc_id", least=(F.min("doc_id"), F.min))
    copy = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False))
    return first.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))


def removal_steps(n_filters: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """All orders of the filters, and the step (from 1) at which each removes each mask: [mask, order], n+1 for never."""
    orders = list(itertools.permutations(range(n_filters)))
    position = np.argsort(np.array(orders), axis=1).T + 1  # [filter, order]
    fails = (np.arange(1 << n_filters)[:, None] >> np.arange(n_filters)) & 1
    gate = np.where(fails == 1, 0, n_filters + 1)
    return orders, np.minimum((gate[:, :, None] + position[None]).min(axis=1), n_filters + 1)


def _scatter(filters: str):
    orders, step = removal_steps(len(filters))
    n = len(filters)
    at = np.array(orders)  # [order, step - 1]: the filter applied
    names = ["".join(filters[f] for f in o) for o in orders]
    fails = ((np.arange(1 << n)[:, None] >> np.arange(n)) & 1).astype(bool)
    late = np.array([[fails[:, at[k, s]] & (step[:, k] <= s) for s in range(n)] for k in range(len(orders))])  # removed before its filter's turn
    columns = np.broadcast_to(np.arange(len(orders)), step.shape)

    def lost(weights: np.ndarray) -> np.ndarray:
        """[order, step - 1]: the weight that each order removes at each step."""
        out = np.zeros((len(orders), n + 2), np.int64)
        np.add.at(out, (columns, step), weights[:, None])
        return out[:, 1 : n + 1]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                weight = np.zeros((3, 1 << n), np.int64)
                for row in held:
                    weight[:, row["mask"]] += (row["n"], row["good"], row["toxic"])
                removed = lost(weight[0])
                shares = np.zeros(n, np.int64)
                np.add.at(shares, at, removed)
                counts = {
                    "kept": weight[0].sum() - removed.cumsum(axis=1),
                    "removed": removed,
                    "redundant": late @ weight[0],
                    "unique_fails": weight[0][1 << at],
                    "good_lost": lost(weight[1]),
                    "toxic_lost": lost(weight[2]),
                    "shapley": shares[at],
                }
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * at.size),
                        pa.array([x for x in names for _ in range(n)]),
                        pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
                        *[pa.array(counts[c].ravel()) for c in _COUNTS],
                        pa.array([filters[f] for f in at.ravel()]),
                    ],
                    ["part", "filter_order", "step", *_COUNTS, "filter"],
                )

    return audit


def order_audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from rows (part, mask, good, toxic).

    ``filters`` names up to six filters by a letter each, bit 0 first. kept and
    removed count the rows after and at the step; redundant the rows that fail
    the step's filter but were gone before; unique_fails those that fail no other;
    good_lost and toxic_lost the marked rows among the removed; shapley the rows
    that the filter removes, summed over all orders. No rows give no parts.
    """
    if not 1 <= len(filters) <= 6:
        raise ValueError("one to six filters: all their orders are listed")
    weights = masks.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic")
    )
    # At most 2^filters weights a part.
    parts = weights.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return parts.mapInArrow(_scatter(filters), f"part string, filter_order string, step int, {counts}, filter string")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of :func:`document_masks`, by source.

    ``labels`` (doc_id, quality, toxic) may miss documents and repeat them: a
    document is good (toxic) if any of its labels has quality (toxic) 1. Null
    doc_ids have no label. Other columns are ignored; an empty table gives an
    empty result.
    """
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    masks = document_masks(docs).join(marks, "doc_id", "left")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").alias(c)
    return order_audit(masks.select("part", "mask", flag("good"), flag("toxic")))
