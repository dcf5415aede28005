"""Removal of repeated byte strings with a sparse suffix array.

A string of ``length`` bytes is judged by its anchor: of its grams of ``GRAM``
bytes the one with the least hash. Equal strings have equal grams at equal
places, so only suffixes around anchors (about one byte in 33) need to be
compared, and of these only those whose gram occurs more than once. Their
contexts are dealt by sampled splitters over the leading bytes of the anchored
suffix, so that equal grams meet.

A bucket arrives sorted by gram and context; equal contexts collapse to their
first place as they stream by, across batches too. What is left of a gram is
sorted, for each distance of a string's start from its anchor, by multikey
quicksort (eight bytes a digit). Suffixes that are tied after ``length`` bytes
are equal strings, and all of them but the earliest are marked; nothing is
matched by hash in a bucket.

Texts move twice: to hand out the contexts of repeated grams, and to take the
marked bytes out. Equal contexts within a worker's slice collapse beforehand, so
a passage that a large part of all documents share sends one context a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import flat_bytes, mixed, release, slices, spread_join, staged

LENGTH, GRAM = 100, 36

#: Documents from which the splitters are sampled (those with the smallest hashes), and suffixes taken from each.
SPLIT_DOCS, SPLIT_SUFFIXES = 2000, 50

#: Contexts of one gram that a task holds; a gram with more of them is compared string by string over many tasks.
HELD_BYTES = 16 << 20

#: Low bits of a packed anchor: windows before it and windows in all, seven bits each.
_BITS = 7
_NO_ID = -(2**63)
_PLACE = ("_id", "_row", "_tag", "start")
_SPAN = "_row long, _tag long, start long, end long"
_POWER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_POWER, -1, 2**64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class RollingHash:
    """Hashes of all substrings of one length, from one cumulative sum."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        n = len(data)
        spread = mixed(np.arange(256, dtype=np.uint64), seed)
        with np.errstate(over="ignore"):
            self.total = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(spread[data] * _powers(n, _INVERSE), out=self.total[1:])
            self.power = _powers(n, _POWER)

    def all(self, length: int) -> np.ndarray:
        n = len(self.total) - length
        with np.errstate(over="ignore"):
            return mixed((self.total[length:] - self.total[:n]) * self.power[:n]) if n > 0 else np.zeros(0, np.uint64)


def least_positions(values: np.ndarray, window: int) -> np.ndarray:
    """Where the least of each ``window`` values stands, the first of equals."""
    n = len(values)
    if n < window:
        return np.zeros(0, dtype=np.int64)
    bits = np.uint64(int(n).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    v = (values & ~low) | np.arange(n, dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    rest = window - span
    if rest:
        v = np.minimum(v[:-rest], v[rest:])
    return (v & low).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of all anchors: hash of the gram, text, first window, anchor, number of windows (places within the text)."""
    hashes = RollingHash(data).all(GRAM)
    place = least_positions(hashes, length - GRAM + 1)
    n = len(place)
    ends = np.minimum(offsets[1:] - length + 1, n)
    sizes = np.maximum(ends - offsets[:-1], 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + offsets[:-1][doc]
    at = place[start]
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    h = np.flatnonzero(head)
    count = np.diff(np.concatenate([h, [len(doc)]]))
    d = doc[h]
    return hashes[at[h]], d, start[h] - offsets[d], at[h] - offsets[d], count


def _identity(docs: DataFrame) -> DataFrame:
    """_id (doc_id, null below all), _row and _tag (82 bits of doc_id and text, the row's key) and _t (bytes) of each row."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(
        known.alias("_id"),
        F.xxhash64(known, text).alias("_row"),
        F.pmod(F.hash(text), F.lit(2**18)).cast("long").alias("_tag"),
        text.alias("_t"),
    )


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_t", 4 << 20):
        h, d, first, at, count = anchors(*flat_bytes(batch.column(3)))
        tag = batch.column(2).to_numpy(zero_copy_only=False)[d]
        packed = ((tag << 31 | at) << _BITS | (at - first)) << _BITS | (count - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h.view(np.int64)), batch.column(1).take(pa.array(d)), pa.array(packed)], ["h", "_row", "packed"]
        )


def repeated_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column: those whose value another row has, without that column."""
    held: pa.RecordBatch | None = None  # the last row so far, and whether it is known to repeat
    held_known = False
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy(zero_copy_only=False)
        same = values[1:] == values[:-1]
        repeat = np.zeros(len(values), dtype=bool)
        repeat[1:] |= same
        repeat[:-1] |= same
        if held is not None:
            again = held.column(0)[0].as_py() == values[0]
            if again:
                repeat[0] = True
            if again or held_known:
                yield held.select(held.schema.names[1:])
        held, held_known = batch.slice(len(values) - 1), bool(repeat[-1])
        repeat[-1] = False
        if repeat.any():
            yield batch.filter(pa.array(repeat)).select(batch.schema.names[1:])
    if held is not None and held_known:
        yield held.select(held.schema.names[1:])


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """_row and packed of the anchors whose gram hash occurs more than once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(repeated_runs, "_row long, packed long")


def _splitters(docs: DataFrame, buckets: int) -> np.ndarray:
    """Leading eight bytes of suffixes that cut a bounded sample into ``buckets`` equal parts."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            data, offsets = flat_bytes(batch.column(3))
            h, d, _, at, _ = anchors(data, offsets)
            order = np.lexsort((h, d))  # the least hashes of each text: a sample that depends on content only
            rank = np.arange(len(d)) - np.searchsorted(d[order], d[order])
            pick = order[rank < SPLIT_SUFFIXES]
            lead = _leads(data, offsets[d[pick]] + at[pick])
            yield pa.RecordBatch.from_arrays([pa.array((lead >> np.uint64(1)).astype(np.int64))], ["lead"])

    sample = docs.orderBy("_row", "_tag").limit(SPLIT_DOCS)
    found = np.sort(np.array([r[0] for r in sample.mapInArrow(leads, "lead long").collect()], dtype=np.uint64))
    if not len(found):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(found[(np.arange(1, buckets) * len(found)) // buckets])


def _leads(data: np.ndarray, at: np.ndarray, width: int = 8) -> np.ndarray:
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        out = out << np.uint64(8) | data[at + k].astype(np.uint64)
    return out


def _context_maker(splitters: np.ndarray, length: int):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_t"):
            ids, rows, tags = (batch.column(c).to_pylist() for c in range(3))
            raws = [t.as_buffer().to_pybytes() for t in batch.column(3)]
            first: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
            level: list[tuple[tuple[int, bytes], tuple[int, int, int, int]]] = []  # other rows at the first one's place
            gone: list[tuple[int, int, int, int, int]] = []
            for doc in sorted(range(len(ids)), key=ids.__getitem__):
                raw, me, row, tag = raws[doc], ids[doc], rows[doc], tags[doc]
                for packed in sorted(set(batch.column(4)[doc].as_py())):
                    count = (packed & 127) + 1
                    before = packed >> _BITS & 127
                    at = packed >> 2 * _BITS & (2**31 - 1)
                    start = at - before
                    end = start + count - 1 + length
                    key = (before, raw[start:end])
                    place = (me, row, tag, start)
                    seen = first.setdefault(key, place)
                    if (seen[0], seen[3]) < (me, start):
                        if gone and gone[-1][:3] == (me, row, tag) and gone[-1][3] <= start <= gone[-1][4]:
                            start = gone.pop()[3]  # anchors ascend: what overlaps is one stretch
                        gone.append((me, row, tag, start, end))
                    elif seen != place:
                        level.append((key, place))
            keys = [*first, *(k for k, _ in level)]
            places = [*first.values(), *(p for _, p in level)]
            lead = np.array([int.from_bytes(c[b : b + 8], "big") for b, c in keys], dtype=np.uint64)
            bucket = np.searchsorted(splitters, lead >> np.uint64(1), side="right")
            n, m = len(keys), len(gone)
            spread = np.arange(m) % (len(splitters) + 1)  # marked already: they only travel along
            long = lambda i: pa.array([p[i] for p in places] + [g[i] for g in gone], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([bucket, spread]).astype(np.int32)),
                    pa.array([c for _, c in keys] + [None] * m, pa.binary()),
                    pa.array([b for b, _ in keys] + [None] * m, pa.int32()),
                    *(long(i) for i in range(4)),
                    pa.array([None] * n + [g[4] for g in gone], pa.int64()),
                ],
                ["bucket", "context", "before", *_PLACE, "end"],
            )

    return contexts


def multikey_sort(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[at:] within each group, and for each place the first place it is tied with.

    ``group`` ascends. Digit by digit, only what is still tied looks at the next
    eight bytes, and only groups that differ there are moved; after ``length``
    bytes tied suffixes are equal strings.
    """
    n = len(at)
    order, head = np.arange(n), np.arange(n)
    if not n:
        return order, head
    new = np.ones(n, dtype=bool)
    new[1:] = group[1:] != group[:-1]
    head = np.maximum.accumulate(np.where(new, head, 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    for digit in range(0, length, 8):
        if not len(tied):
            break
        value = _leads(data, at[order[tied]] + digit, min(8, length - digit))
        h = head[tied]
        fresh = np.ones(len(tied), dtype=bool)
        fresh[1:] = h[1:] != h[:-1]
        number = np.cumsum(fresh) - 1
        differs = np.zeros(number[-1] + 1, dtype=bool)
        differs[number[1:][(value[1:] != value[:-1]) & ~fresh[1:]]] = True
        move = np.flatnonzero(differs[number])
        if not len(move):
            continue
        inner = move[np.lexsort((value[move], h[move]))]
        order[tied[move]] = order[tied[inner]]
        value[move] = value[inner]
        fresh[1:] |= value[1:] != value[:-1]
        head[tied] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        tied = tied[~(fresh & np.append(fresh[1:], True))]
    return order, head


def marked_windows(
    data: np.ndarray, offsets: np.ndarray, before: np.ndarray, group: np.ndarray, ids: np.ndarray, starts: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first string and one past the last of the strings that occur earlier among the contexts.

    Strings start up to ``length - GRAM`` bytes before their anchor. Equal ones
    have their anchor at one place, so each distance is a sort of its own, with
    at most one string of a context.
    """
    counts = np.diff(offsets) - length + 1
    hits = []
    for distance in range(int(before.max(initial=-1)) + 1):
        step = before - distance
        own = np.flatnonzero((step >= 0) & (step < counts))
        order, head = multikey_sort(data, offsets[own] + step[own], group[own], length)
        tied = np.flatnonzero(np.bincount(head, minlength=len(own))[head] > 1) if len(own) else head
        if not len(tied):
            continue
        c = own[order[tied]]
        i, at = ids[c], starts[c] + step[c]
        by_place = np.lexsort((at, i, head[tied]))
        c, i, at, h = c[by_place], i[by_place], at[by_place], head[tied]
        first = np.searchsorted(h, h)
        later = (i[first] < i) | (at[first] < at)  # sorted: a larger id, or the same one and a later start
        hits.append(c[later] << 8 | step[c[later]])
    found = np.sort(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
    cut = np.ones(len(found), dtype=bool)
    cut[1:] = np.diff(found) != 1
    heads, ends = np.flatnonzero(cut), np.flatnonzero(np.append(cut[1:], True)[: len(found)])
    return found[heads] >> 8, found[heads] & 255, (found[ends] & 255) + 1


def _bucket_worker(length: int, held_bytes: int):
    names = [*_PLACE[1:], "end", "id", "context"]

    def spans(row, tag, start, end) -> pa.RecordBatch:
        n = len(start)
        columns = [pa.array(np.asarray(x), pa.int64()) for x in (row, tag, start, end)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

    def whole(rows: pa.RecordBatch) -> pa.RecordBatch:
        """Contexts of a gram that has too many for one task."""
        columns = [rows.column(c) for c in (*_PLACE[1:], "end", "_id", "context")]
        return pa.RecordBatch.from_arrays(columns, names)

    def changes(column: pa.Array) -> np.ndarray:
        """Which rows differ from the one before; the first does."""
        out = np.ones(len(column), dtype=bool)
        out[1:] = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        return out

    def compare(rows: pa.Table) -> pa.RecordBatch | None:
        rows = rows.combine_chunks()
        gram = np.cumsum(changes(rows.column("gram").chunk(0)))
        alone = np.bincount(gram)[gram] < 2
        if alone.any():
            rows, gram = rows.filter(pa.array(~alone)).combine_chunks(), gram[~alone]
        if not rows.num_rows:
            return None
        row, tag, ids, starts = (rows.column(c).to_numpy() for c in ("_row", "_tag", "_id", "start"))
        data, offsets = flat_bytes(rows.column("context").chunk(0))
        before = rows.column("before").to_numpy().astype(np.int64)
        c, first, last = marked_windows(data, offsets, before, gram, ids, starts, length)
        return spans(row[c], tag[c], starts[c] + first, starts[c] + last - 1 + length) if len(c) else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        goes_on = None  # a gram whose contexts are handed on
        same: tuple | None = None  # the context that came last, and its first place
        for batch in batches:
            marked = batch.column("end").is_valid()
            done = batch.filter(marked)
            if done.num_rows:
                yield spans(*(done.column(c) for c in ("_row", "_tag", "start", "end")))
            batch = batch.filter(pc.invert(marked))
            if not batch.num_rows:
                continue
            # equal contexts follow each other, the earliest first
            ids, starts = batch.column("_id").to_numpy(), batch.column("start").to_numpy()
            new = changes(batch.column("context")) | changes(batch.column("before"))
            place = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            first_id, first_start = ids[place], starts[place]
            key = lambda k: (batch.column("context")[k].as_py(), batch.column("before")[k].as_py())
            if same is not None and same[0] == key(0):
                first_id, first_start = np.where(place == 0, same[1], first_id), np.where(place == 0, same[2], first_start)
            same = (key(len(ids) - 1), first_id[-1], first_start[-1])
            again = (ids > first_id) | (ids == first_id) & (starts > first_start)
            if again.any():
                twice = batch.filter(pa.array(again))
                end = starts[again] + pc.binary_length(twice.column("context")).to_numpy()
                yield spans(twice.column("_row"), twice.column("_tag"), starts[again], end)
                batch = batch.filter(pa.array(~again))
            if goes_on is not None and batch.num_rows:
                more = pc.equal(batch.column("gram"), pa.scalar(goes_on, pa.binary()))
                if (rest := batch.filter(more)).num_rows:
                    yield whole(rest)
                batch = batch.filter(pc.invert(more))
                goes_on = None if batch.num_rows else goes_on
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < held_bytes:
                continue
            rows = pa.Table.from_batches(held)
            last = rows.column("gram")[-1]
            cut = pc.index(rows.column("gram"), last).as_py()  # sorted by gram: the last group may go on
            if cut:
                if (out := compare(rows.slice(0, cut))) is not None:
                    yield out
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
            else:
                for b in held:
                    yield whole(b)
                held, size, goes_on = [], 0, last.as_py()
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return work


def _window_rows(length: int):
    """Of each context the 128-bit digest of every string of ``length`` bytes, and where it stands."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                raws = part.column(4).to_pylist()
                counts = np.array([len(raw) - length + 1 for raw in raws])
                w = [hashlib.blake2b(raw[s : s + length], digest_size=16).digest() for raw, n in zip(raws, counts.tolist()) for s in range(n)]
                owner = np.repeat(np.arange(len(raws)), counts)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                id_, row, tag, start = (part.column(c).take(pa.array(owner)) for c in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), id_, row, tag, pc.add(start, pa.array(step))], ["w", *_PLACE])

    return windows


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "_t"):
        removed, spans, shas, sizes = [], [], [], []
        for text, marks in zip(batch.column(1), batch.column(2).to_pylist()):
            raw = text.as_buffer().to_pybytes()
            merged: list[list[int]] = []
            for s, e in sorted((m["start"], m["end"]) for m in marks or []):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            kept, at = hashlib.sha256(), 0
            for s, e in merged:
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            sizes.append(len(raw))
            removed.append(sum(e - s for s, e in merged))
            spans.append(len(merged))
            shas.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())],
            ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _release_all(spark: SparkSession) -> None:
    """Release the shuffles of the job that ran last, too: Spark holds on to its plan until another job has run."""
    spark.range(1).collect()
    release(spark)


def repeated_spans(docs: DataFrame, length: int = LENGTH, held_bytes: int = HELD_BYTES) -> DataFrame:
    """_row, _tag, start, end of bytes covered by a string of ``length`` that starts earlier; spans may overlap."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _identity(docs)
    repeated = staged(repeated_anchors(rows.mapInArrow(_anchor_rows, "h long, _row long, packed long")), "anchors")
    _release_all(spark)
    tag_of = F.shiftright("packed", 31 + 2 * _BITS)
    per_doc = repeated.groupBy("_row", tag_of.alias("_tag")).agg(F.collect_list("packed").alias("_anchors"))  # one document's
    splitters = _splitters(rows, 4 * parts)
    with_anchors = rows.join(per_doc, ["_row", "_tag"]).select("_id", "_row", "_tag", "_t", "_anchors")
    contexts = with_anchors.mapInArrow(
        _context_maker(splitters, length), "bucket int, context binary, before int, _id long, _row long, _tag long, start long, end long"
    )
    gram = F.expr(f"substring(context, before + 1, {GRAM})")
    dealt = contexts.repartition(parts, "bucket").withColumn("gram", gram).drop("bucket")
    dealt = dealt.sortWithinPartitions("gram", "context", "before", "_id", "start")
    out = staged(dealt.mapInArrow(_bucket_worker(length, held_bytes), _SPAN + ", id long, context binary"), "repeats")
    _release_all(spark)
    hot = out.filter("context is not null").select(F.col("id").alias("_id"), "_row", "_tag", "start", "context")
    return out.filter("context is null").drop("id", "context").union(_hot_spans(hot, length))


def _hot_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The spans of grams with too many contexts: their strings meet by their digests, and a string's first place is a minimum."""
    made = contexts.mapInArrow(_window_rows(length), "w binary, _id long, _row long, _tag long, start long")
    strings = staged(made, "strings")
    first = strings.groupBy("w").agg(F.min(F.struct("_id", "start")).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    later = spread_join(strings, "w", F.struct("_row", "start"), first).filter(F.struct("_id", "start") > F.col("_first"))
    return later.select("_row", "_tag", "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts earlier
    (in a smaller doc_id, or earlier in the document) is removed, judged on the
    input. Null texts are empty. A null doc_id is below all others. Rows that
    share a doc_id, with equal texts or different ones, stand at one place in
    the order: at equal starts neither is earlier. A text is held whole by one
    task, with some 60 bytes for each of its own. An empty table gives no rows;
    other columns are ignored.
    """
    if not GRAM < length <= GRAM + 127:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 127}")
    spans = repeated_spans(docs, length, held_bytes).groupBy("_row", "_tag").agg(F.collect_list(F.struct("start", "end")).alias("_marks"))
    rows = _identity(docs).join(spans, ["_row", "_tag"], "left").select("_id", "_t", "_marks")
    out = rows.mapInArrow(_clean, "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    doc_id: Column = F.when(F.col("_id") != _NO_ID, F.col("_id"))
    return out.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
