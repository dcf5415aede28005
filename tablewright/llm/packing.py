"""Best-fit packing of token sequences after a Martello-Toth reduction.

Only lengths matter to packing, and there are at most ``capacity`` different
ones, so the instance is a histogram: however many documents there are, the
driver sees ``capacity`` numbers. On it, sets of lengths that provably dominate
every other filling of a sequence are fixed first (a length alone when nothing
fits beside it; two that fill the sequence exactly; the largest partner when no
two lengths together could do better), and best fit decreasing packs the rest.
The result is a list of fillings with their multiplicities. Pieces are numbered
within their length, and each number looks up its place in the list.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import slices, staged

CAPACITY, END_ID = 4096, 1

#: Pieces of one length are numbered in so many buckets at once.
BUCKETS = 1024

#: A worker remembers the ids of about so many different words.
REMEMBERED = 500_000


_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
# ASCII punctuation without the apostrophe, which starts tokens of its own.
_PUNCTUATED = re.compile(r"([!-&(-/:-@\[-`{-~]*)(.*?)([!-&(-/:-@\[-`{-~]*)", re.DOTALL)

#: Stands between words given to the tokenizer together: one token, and no word's.
MARK = "\x01"


def _tokeniser_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Token ids of texts by a tokenizer that never joins across white space.

    A text is its words' ids in a row, and a word mostly a core in lower case
    with ASCII punctuation before and after it, which this tokenizer never
    joins with letters or digits. Words and cores are remembered, so the
    tokenizer sees each new core once. It gets many in one text: runs of letters
    end where their last token says so, others have a mark between them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokeniser = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {"": b""}
        names = self.tokeniser.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        (self.mark_id,) = self.tokeniser.encode(MARK, add_special_tokens=False).ids

    def __call__(self, texts: list[str]) -> list[bytes]:
        # str.split also cuts at the four separators below, which the tokenizer does not take for white space.
        split = [_SPACE.split(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.cores) > REMEMBERED:
            self.cores = {"": b""}
        known, cores = self.words, self.cores
        new.difference_update(known)
        parts = {w: _parted(w) for w in new}
        self._learn({c for p in parts.values() for c in p if c not in cores})
        for w, (x, y, z) in parts.items():
            known[w] = cores[x] + cores[y] + cores[z]
        return [b"".join([known[w] for w in words]) for words in split]

    def _learn(self, cores: set[str]) -> None:
        marked = [c for c in cores if MARK in c or "<|" in c]
        for c in marked:
            self.cores[c] = np.array(self.tokeniser.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes()
        others = sorted(c for c in cores.difference(marked) if not c.isalpha())
        self._learn_marked(others)
        letters = sorted(c for c in cores.difference(marked) if c.isalpha())
        for at in range(0, len(letters), 2000):
            part = letters[at : at + 2000]
            ids = self._ids(" ".join(part))
            ends = np.flatnonzero(self.closes[ids]) + 1  # a run of letters ends where a word-end token stands
            if len(ends) == len(part):
                self._keep(part, ids, np.concatenate([[0], ends[:-1]]), ends)
            else:
                self._learn_marked(part)

    def _learn_marked(self, cores: list[str]) -> None:
        for at in range(0, len(cores), 2000):
            part = cores[at : at + 2000]
            ids = self._ids(f" {MARK} ".join(part))
            marks = np.flatnonzero(ids == self.mark_id)
            self._keep(part, ids, np.concatenate([[0], marks + 1]), np.concatenate([marks, [len(ids)]]))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokeniser.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _keep(self, cores: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = ids.tobytes()
        for c, s, e in zip(cores, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
            self.cores[c] = data[s:e]


def _parted(word: str) -> tuple[str, str, str]:
    """Punctuation, core, punctuation; the word as it is where cutting or lower-casing might change its ids."""
    before, core, after = _PUNCTUATED.fullmatch(word).groups()
    if not core or not (core[0].isalnum() and core[-1].isalnum()) or "<|" in word:
        return word, "", ""
    if not core.isascii() and ("\u03a3" in core or "\u0130" in core or not unicodedata.is_normalized("NFC", core)):
        return word, "", ""
    return before, core.lower(), after


@functools.lru_cache(maxsize=2)
def _ids_of(path: str) -> WordIds:
    """One memory for all tasks of a worker."""
    return WordIds(path)


def _piece_maker(path: str, capacity: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids_of(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in slices(batches, "text"):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, data in enumerate(ids([t or "" for t in batch.column(1).to_pylist()])):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pieces


def reduce_by_dominance(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating fillings; ``counts`` keeps what they leave.

    For the longest length left, with ``room`` beside it: nothing fits, so it
    stands alone; a length equal to ``room`` fills the sequence, and so does at
    least as well as any other set; if no two lengths fit together in ``room``,
    its longest partner dominates. Where none of these holds, shorter lengths
    are tried for an exact partner, which dominates for any of them.
    """
    fixed: list[tuple[tuple[int, ...], int]] = []

    def fix(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for s in lengths:
            counts[s] -= times

    for s in range(capacity, 0, -1):
        if not counts[s]:
            continue
        room = capacity - s
        smallest = np.flatnonzero(counts)
        if not room or smallest[0] > room:
            fix((s,), int(counts[s]))
            continue
        if s == room:
            if counts[s] > 1:
                fix((s, s), int(counts[s] // 2))
            continue
        if room < s and counts[room]:
            fix((s, room), int(min(counts[s], counts[room])))
    while True:  # the longest that is left, while at most one more fits beside it
        left = np.flatnonzero(counts)
        if not len(left):
            return fixed
        s = int(left[-1])
        room = capacity - s
        if left[0] > room:
            fix((s,), int(counts[s]))
            continue
        two = 2 * int(left[0]) if counts[left[0]] > 1 else int(left[0]) + int(left[1]) if len(left) > 1 else capacity + 1
        k = int(left[np.searchsorted(left, room, side="right") - 1])
        if two <= room or k == s:
            return fixed
        fix((s, k), int(min(counts[s], counts[k])))


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over a histogram; sequences filled alike are handled together."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    done: list[tuple[tuple[int, ...], int]] = []
    for s in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[s])
        for room in sorted(r for r in open_ if r >= s):
            # Best fit goes on filling the sequence it has just used.
            per = room // s
            while n and open_[room]:
                lengths, times = open_[room].pop()
                full = min(times, n // per)
                if full < times:
                    open_[room].append((lengths, times - full))
                if full:
                    _put(open_, done, lengths + (s,) * per, full, room - per * s)
                    n -= full * per
                elif n:
                    lengths, times = open_[room].pop()
                    if times > 1:
                        open_[room].append((lengths, times - 1))
                    _put(open_, done, lengths + (s,) * n, 1, room - n * s)
                    n = 0
            if not open_[room]:
                del open_[room]
            if not n:
                break
        if n:
            per = capacity // s
            if n // per:
                _put(open_, done, (s,) * per, n // per, capacity - per * s)
            if n % per:
                _put(open_, done, (s,) * (n % per), 1, capacity - (n % per) * s)
    return done + [x for group in open_.values() for x in group]


def _put(open_: dict, done: list, lengths: tuple[int, ...], times: int, room: int) -> None:
    if room:
        open_[room].append((lengths, times))
    else:
        done.append((lengths, times))


def places(fillings: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first number, one past the last, first sequence, pieces a sequence, first offset), sorted."""
    out, taken, sequence = [], defaultdict(int), 0
    for lengths, times in fillings:
        offset = 0
        i = 0
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            s, per = lengths[i], j - i
            out.append((s, taken[s], taken[s] + per * times, sequence, per, offset))
            taken[s] += per * times
            offset += per * s
            i = j
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 6)


def _placer(table: np.ndarray):
    base = table[:, 0] << 48 | table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            number = batch.column(names.index("_number")).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(base, length << 48 | number, side="right") - 1]
            at = number - row[:, 1]
            sequence, offset = row[:, 3] + at // row[:, 4], row[:, 5] + at % row[:, 4] * length
            keep = [n for n in names if n != "_number"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index(n)) for n in keep] + [pa.array(sequence), pa.array(offset)],
                [*keep, "sequence_id", "offset"],
            )

    return place


def numbered(pieces: DataFrame) -> DataFrame:
    """Number the pieces from 0 within each length, in buckets so that no length is one task."""
    marked = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int"))
    counts = marked.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        marked.withColumn("_k", F.row_number().over(within))
        .join(starts, ["length", "_bucket"])
        .withColumn("_number", F.col("_start") + F.col("_k") - 1)
        .drop("_bucket", "_k", "_start")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, tokeniser_path: str | None = None) -> DataFrame:
    """Pieces of the documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end id; null and empty texts are the
    end id alone. Longer ones are cut into pieces of ``capacity``. Rows that
    repeat a doc_id are packed each on its own; an empty table gives no rows.
    Other columns are ignored.
    """
    path = tokeniser_path or _tokeniser_path()
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = staged(
        docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
            _piece_maker(path, capacity), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
        ),
        "pieces",
    )
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    fillings = reduce_by_dominance(counts, capacity)
    table = places(fillings + best_fit(counts, capacity))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "_number").mapInArrow(_placer(table), schema)
