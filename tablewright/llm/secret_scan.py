"""Secrets: fixed patterns, and strings that a tokenizer finds hard to spell.

A byte-pair vocabulary spells words, names and paths with several characters a
token, but random strings with few. Every run of a key's alphabet is tested once
what is known has been set aside: UUIDs, digests (hexadecimal, of a hash
function's length), numbers, and words in one case. What stands between the
outermost unknown segments of a run is taken for a random secret if its
characters per token stay below a limit; so is a single segment, or the whole
run, that does. A path before a key therefore does not hide it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import slices

KINDS = ("assign", "access", "hex")

# Fixed patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_VALUE, MIN_ACCESS = 6, 20
KEYWORD_STEMS = ("passw", "secret", "token", "api")

#: A candidate: so many characters of a key's alphabet, digits or not.
MIN_RANDOM = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RANDOM)
CHARS_PER_TOKEN = 2.2

#: Long strings are spelled in blocks of so many characters, as merging takes more than linear time.
BLOCK = 4096

DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
_WORD = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[A-Z][a-z]+")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")


def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(value: str) -> bool:
    """UUIDs, digests, and words and numbers between separators: no secrets however random they look."""
    return all(_known_segment(x) for x in _SEGMENT.findall(_UUID.sub("-", value)))


def _known_segment(value: str) -> bool:
    return bool(_WORD.fullmatch(value) or len(value) in DIGEST_LENGTHS and _DIGEST.fullmatch(value))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kinds as numbered in KINDS, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORD_STEMS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def random_spans(text: str, vocabulary, limit: float = CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """(start, end) of candidates that take more tokens than their length explains."""

    def hard(start: int, end: int) -> bool:
        if end - start < MIN_RANDOM:
            return False
        tokens = sum(len(vocabulary.encode_ordinary(text[k : min(k + BLOCK, end)])) for k in range(start, end, BLOCK))
        return end - start < limit * tokens

    out = []
    for m in CANDIDATE.finditer(text):
        start = m.start()
        for end, after in [*(u.span() for u in _UUID.finditer(text, *m.span())), (m.end(), m.end())]:
            unknown = [x.span() for x in _SEGMENT.finditer(text, start, end) if not _known_segment(x[0])]
            if unknown:
                last = unknown[-1][1]
                while last < end and text[last] == "=":  # padding belongs to its key
                    last += 1
                if hard(unknown[0][0], last):
                    out.append((unknown[0][0], last))
                elif single := [x for x in unknown if hard(*x)]:
                    out += single
                elif hard(start, end):
                    out.append((start, end))
            start = after
    return out


def _scanner(path: str, limit: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in slices(batches, "text"):
            counts, shas, spans = [[], [], []], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = random_spans(text or "", vocabulary, limit)
                for k in range(3):
                    counts[k].append(sum(kind == k for _, kind, _ in base))
                named = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
                shas.append(hashlib.sha256(named.encode()).hexdigest())
                all_ = sorted(base + [(s, len(KINDS), e) for s, e in more])
                spans.append(",".join(f"{(*KINDS, 'random')[k]}:{s}:{e}" for s, k, e in all_))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return scan


def secret_spans(docs: DataFrame, vocabulary_path: str | None = None, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points by start, then kind; ``random`` is
    the kind of those that the tokenizer shows. They have ``MIN_RANDOM``
    characters or more; random strings of small letters alone, or of capitals
    alone, look like words and are left. Null texts count as empty
    and have none; rows that repeat are scanned each; an empty table gives no
    rows; other columns are ignored.
    """
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _scanner(vocabulary_path, limit), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
