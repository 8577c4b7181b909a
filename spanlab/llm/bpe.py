"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the split pattern is merged on its own.  The leaves of the tree are the byte positions; a leaf holds
``rank << bits | position`` of the pair that starts there, so the root is the leftmost pair of the least rank.  A
merge updates two leaves - the merged piece and its live left neighbour - and clears one, each in logarithmic time,
so a match of n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct matches whose encoding a worker remembers; beyond it the memory starts afresh, results do not change.
CACHE_ENTRIES = 1_000_000
#: Longer matches are not remembered.
CACHE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def compile_split(pattern: str, last: int = 0xFFFF) -> re.Pattern:
    r"""The split pattern for ``re``, which is faster than ``regex``, for texts of code points up to last.

    \p{L}, \p{N}, \s and \S become explicit classes taken from ``regex``'s own Unicode tables, as those of ``re``
    differ.  A pattern with other properties stays with ``regex``.  ``re`` looks classes up in constant time only
    up to U+FFFF.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, last + 1)]))

    def members(prop: str) -> str:
        runs = (m.group() for m in regex.finditer(rf"{prop}+", every))
        return "".join(f"\\U{ord(x[0]):08x}-\\U{ord(x[-1]):08x}" for x in runs)

    inner = {p: members(p) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}")}
    out, in_class, i = [], False, 0
    while i < len(pattern):
        for name, key in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}"), (r"\S", None)):
            if pattern.startswith(name, i):
                if key is None:
                    if in_class:
                        return regex.compile(pattern)
                    out.append(f"[^{inner[chr(92) + 'p{White_Space}']}]")
                else:
                    out.append(inner[key] if in_class else f"[{inner[key]}]")
                i += len(name)
                break
        else:
            if pattern.startswith((r"\p", r"\P", r"\X"), i):
                return regex.compile(pattern)
            in_class = pattern[i] == "[" or in_class and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return re.compile("".join(out))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match.  A byte or piece that the ranks lack raises KeyError."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    bits = (n - 1).bit_length()
    size = 1 << bits
    none = 1 << 62
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            tree[size + i] = r << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # where the live piece at i ends
    before = list(range(-1, n))  # where the live piece left of i starts
    best = tree[1]
    while best < none:
        i = best & (size - 1)
        mid = after[i]
        after[i] = end = after[mid]
        r = None
        if end < n:
            before[end] = i
            r = get(piece[i : after[end]])
        changes = [(mid, none), (i, none if r is None else r << bits | i)]
        if i:
            h = before[i]
            r = get(piece[h:end])
            changes.append((h, none if r is None else r << bits | h))
        for k, value in changes:
            k += size
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < value:
                    value = other
                if tree[k] == value:
                    break
                tree[k] = value
        best = tree[1]
    ids, i = [], 0
    while i < n:
        end = after[i]
        ids.append(ranks[piece[i:end]])
        i = end
    return ids


class ByteBPE:
    """encode(text) -> ids and decode(ids) -> bytes, as a rank file and split pattern define them."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.splits = [compile_split(pattern, last) for last in (0x7F, 0xFF, 0xFFFF)] + [regex.compile(pattern)]
        self.pieces = {str(v): k for k, v in self.ranks.items()}
        self.seen: dict[str, str] = {}

    def _of(self, match: str) -> str:
        ids = " ".join(map(str, merge_bytes(match.encode("utf-8", "replace"), self.ranks)))
        if len(match) <= CACHE_BYTES:
            if len(self.seen) >= CACHE_ENTRIES:
                self.seen.clear()
            self.seen[match] = ids
        return ids

    def split(self, text: str) -> list[str]:
        if text.isascii():
            k = 0
        elif len(wide := text.encode("utf-16-le", "surrogatepass")) > 2 * len(text):
            k = 3
        else:
            k = 1 if not any(wide[1::2]) else 2
        return self.splits[k].findall(text)

    def encode_text(self, text: str) -> str:
        """The decimal ids joined by one space."""
        get, of = self.seen.get, self._of
        return " ".join([get(m) or of(m) for m in self.split(text)])

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in self.encode_text(text).split()]

    def decode_text(self, ids: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.split(" "))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_text(" ".join(map(str, ids)))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    """One codec per worker process: ranks and memory serve all its tasks."""
    return ByteBPE(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and ``ids array<int>``.  Null and empty text give an empty array.

    A map over Arrow batches: no shuffle, and a task holds one batch.  Repeated rows and null ids pass through; other
    columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse of encode_documents: ``bytes binary`` per row; null ids give empty bytes, unknown ids raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            out = [c.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def roundtrip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents and decode_documents in one pass, with digests in place of ids and bytes.

    Columns: id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256, n_bytes.  The same
    codec runs; only the ids do not travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path, pattern), hashlib.sha256
        for b in batches:
            n, a, d, size = [], [], [], []
            for t in b.column(1).to_pylist():
                ids = c.encode_text(t or "")
                back = c.decode_text(ids)
                n.append(ids.count(" ") + 1 if ids else 0)
                a.append(sha(ids.encode("ascii")).hexdigest())
                d.append(sha(back).hexdigest())
                size.append(len(back))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(size, pa.int64())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")
    return out.withColumnRenamed("id", id_col)
