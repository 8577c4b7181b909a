"""Suffix-array dedup: byte passages that occur again, by blockwise suffix sorting with a difference cover.

Candidates come from repeats.py as contexts grouped by a shared anchor.  A block of them is laid out with the anchors at
multiples of V, and its suffixes are sorted one bucket at a time.  A bucket is the suffixes of one residue modulo V that
start with the same V bytes; ties that go on longer are resolved by the ranks of the cover sample: positions whose
residue is in a difference cover of V, ranked beforehand by prefix doubling over the sample alone.  Memory is that of
the sample and of one residue's keys.  Neighbours in the order that agree in ``size`` bytes are one window, which occurs
as often as the contexts that have it do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.lines import NO_ID
from spanlab.llm.repeats import merged, repeated_spans

V = 32
MIN_BYTES, GRAM = 200, 64
#: A number for each byte; its last eight bits are the byte, so that cut to a byte it is the byte again.
_RANDOM = (np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)


def difference_cover(v: int) -> np.ndarray:
    """Residues such that every difference modulo v is one of two of them; greedy."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max((x for x in range(1, v) if x not in cover), key=lambda x: (len(({(x - c) % v for c in cover} | {(c - x) % v for c in cover}) & missing), -x))
        cover.append(best)
        missing -= {(a - b) % v for a in cover for b in cover}
    return np.array(sorted(cover))


COVER = difference_cover(V)
#: For each residue, the way to the next position of the sample.
STEP = np.array([min((c - r) % V for c in COVER) for r in range(V)])


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number that sorts as they do; zeros follow the end."""
    long, out = np.concatenate([text, np.zeros(8, np.uint8)]), np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | long[i : i + len(text)]
    return out


def _ranked(key: np.ndarray) -> np.ndarray:
    """Ranks from 0; equal keys have equal ranks."""
    order = np.argsort(key)
    s = key[order]
    new = np.zeros(len(s), np.int64)
    new[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(new)
    return rank


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of two ranks; at most 2**31 of each."""
    return _ranked((a << 32) | b)


def cover_ranks(eights: np.ndarray, depth: int) -> np.ndarray:
    """Ranks from 1 of the sample suffixes by their first ``depth`` bytes or more, at their positions; elsewhere 0.

    ``eights`` is that of a text whose length is a multiple of V and which ends in padding of at least depth + V bytes.
    """
    sample = (np.arange(0, len(eights) - V, V)[:, None] + COVER).ravel()
    now = _ranked(eights[sample])
    for i in range(8, V, 8):
        now = _paired(now, _ranked(eights[np.minimum(sample + i, len(eights) - 1)]))
    rank = np.zeros(len(eights) + 2 * V, np.int64)
    rank[sample] = now + 1
    known = V
    while known < depth:
        now = _paired(rank[sample], rank[np.minimum(sample + known, len(rank) - 1)])
        rank[sample] = now + 1
        known *= 2
    return rank


def sort_suffixes(eights: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """The positions ``at``, by residue modulo V, in the order of their first depth bytes or more."""
    rank = cover_ranks(eights, depth)
    out = []
    for r in range(V):  # one group of buckets at a time
        mine = at[at % V == r]
        out.append(mine[np.lexsort([rank[mine + STEP[r]], *(eights[mine + i] for i in range(V - 8, -1, -8))])])
    return out


def repeated_windows(contexts: list[bytes], places: list[int], times: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, repeated?) of every window of the contexts: whether the contexts that have it occur twice or more in all.

    ``places`` are those of the shared anchors, ``times`` says how often each context occurs.  Contexts of many anchors
    may come together, as equal windows have equal anchors.
    """
    room = [-(-(len(c) + V) // V) * V + V for c in contexts]
    base = np.cumsum([0, *room])
    text = np.zeros(int(base[-1]) + 2 * V + -(-size // V) * V * 2, np.uint8)
    starts = base[:-1] + (V - np.array(places)) % V
    for s, c in zip(starts.tolist(), contexts):
        text[s : s + len(c)] = np.frombuffer(c, np.uint8)
    n = np.array([len(c) - size + 1 for c in contexts])
    row = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + window
    where = np.zeros(len(text), np.int64)  # position -> number of its window
    where[at] = np.arange(len(at))
    eights, flags = _eights(text), np.zeros(len(at), bool)
    steps = [*range(0, size - 7, 8), size - 8] if size >= 8 else range(size)
    symbols = eights if size >= 8 else text
    for order in sort_suffixes(eights, at, size):
        if not len(order):
            continue
        x, y = order[:-1], order[1:]
        like = np.arange(len(x))
        for i in steps:
            like = like[symbols[x[like] + i] == symbols[y[like] + i]]
        new = np.ones(len(order), bool)
        new[like + 1] = False
        begin = np.flatnonzero(new)
        k = where[order]
        total = np.add.reduceat(times[row[k]], begin)
        flags[k] = np.repeat(total > 1, np.diff(np.append(begin, len(order))))
    return row, window, flags


def compare_bytes(t: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """Ranges of repeated windows (see repeats.py); they go from every document."""
    row, window, flags = repeated_windows(t.column("s").to_pylist(), t.column("place").to_pylist(), t.column("n").to_numpy(), size)
    row, window = row[flags], window[flags]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(row)) - 1
    return row[head], window[head], window[last[: len(head)]], np.full(len(head), NO_ID)


def byte_symbols(text: str | None) -> np.ndarray:
    return _RANDOM[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]


def keyed(docs: DataFrame, id_col: str, text_col: str, no_id: int = NO_ID) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(no_id)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def repeated_passages(docs: DataFrame, size: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id (as ``d``), ``k``, ``text`` and ``spans array<struct<s,e>>`` of bytes to remove, null where there are none.

    A byte goes if a string of ``size`` bytes over it also starts anywhere else, in the same document or another.
    Repeated rows are documents of their own, so all of their bytes go.  Null and empty text: no spans.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, byte_symbols, size, min(GRAM, size), False, compare_bytes, 1)
    return rows.join(spans, ["d", "k"], "left")


def passage_digests(docs: DataFrame, size: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, gone, count, sha = [], [], [], [], []
            for d, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, cuts, at, h = text.encode("utf-8", "replace"), merged(spans), 0, hashlib.sha256()
                for s, e in cuts:
                    h.update(raw[at:s])
                    at = e
                h.update(raw[at:])
                ids.append(None if d == NO_ID else d)
                n.append(len(raw))
                gone.append(sum(e - s for s, e in cuts))
                count.append(len(cuts))
                sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, n, gone, count)), pa.array(sha, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = repeated_passages(docs, size, id_col, text_col).select("d", "text", "spans")
    return out.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
