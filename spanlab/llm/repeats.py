"""Windows of symbols that occur again somewhere in a corpus, exactly, with a few rows a document.

A window is ``size`` symbols in a row of one document (bytes, or hashed words).  Its owner is the k-gram in it with
the least hash (rightmost at ties), k < size: equal windows have equal owners at equal places in them.  The windows that
one k-gram owns follow each other, so a document is a few runs (anchor hash, first and last window), about 2 per
size - k symbols.  Then:

1. Runs are range-partitioned and sorted by anchor, once.  A run stays if a neighbour has its anchor, or if it is at a
   partition's edge; all others cannot repeat.  Nothing is counted or held, so a hot anchor streams through many tasks.
2. Runs of one anchor and one content (a hash over all their windows' symbols) are one context, with the number of its
   runs and the least and greatest document.
3. Contexts of one anchor meet symbol by symbol, by the method that the operator names: it says for each window of
   a context the least document that has it, and whether it occurs again.  Anchors of more than GROUP contexts are
   halved first: the windows that reach far to the left of the anchor share what is left of it, the others what is
   right of it, so each half has a longer anchor, which splits the group by content; equal halves become one context.
   At the end of that an anchor is a whole window, and its contexts are equal.  Work grows with the rows, not with the
   square of a group.
4. What was found in a context holds for all its runs, at their places.

Sums are combined before the shuffle, and joins are sort-merge ones, whose skewed keys the planner splits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import discard, materialize
from spanlab.llm.minhash import mix

#: Symbols worked at once; longer documents are worked in overlapping pieces.
PIECE = 1 << 20
FIELD = 12
#: Contexts that meet at once, at most; about so many bytes of contexts are worked together.
GROUP, BATCH = 1024, 1 << 20
CONTEXT = "a long, v long, d long, k long, place int, gram int, n long, least long, most long, m long, s binary"
_BITS = np.uint64(24)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def owned_runs(sym: np.ndarray, starts: np.ndarray, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows by owner in one array of documents laid end to end: (document, anchor at, first, last, anchor hash, content hash).

    starts has the documents' offsets and the end.  Positions are in the array.
    """
    n = len(sym)
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    width = size - k + 1
    if n < size:
        return none
    up, down = powers(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sym * up[:n])])
    grams = mix((total[k:] - total[:-k]) * down[: n - k + 1])
    mask = (np.uint64(1) << _BITS) - np.uint64(1)
    m = len(grams)
    key = (grams & ~mask) | (mask - np.arange(m, dtype=np.uint64))
    pad = -m % width
    blocks = np.concatenate([key, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: m - width + 1], ahead[width - 1 : m])
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[: len(low)]
    at = np.arange(len(low))
    at = at[at + size <= starts[1:][doc]]
    if not len(at):
        return none
    owner, doc = (mask - (low[at] & mask)).astype(np.int64), doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    first, last, owner = at[head], at[np.append(head[1:], len(at)) - 1], owner[head]
    content = mix((total[last + size] - total[first]) * down[first] + (last - first).astype(np.uint64))
    content = mix(content + (owner - first).astype(np.uint64))
    return doc[head], owner, first, last, grams[owner], content


def _pieces(docs: Iterator[np.ndarray], size: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """([(document, offset in it)], symbols, starts) of about PIECE symbols."""
    held, names, total = [], [], 0
    for d, sym in enumerate(docs):
        for s in range(0, max(len(sym) - size + 1, 0), PIECE):
            part = sym[s : s + PIECE + size - 1]
            held.append(part)
            names.append((d, s))
            total += len(part)
            if total >= PIECE:
                yield names, np.concatenate(held), np.cumsum([0, *map(len, held)])
                held, names, total = [], [], 0
    if held:
        yield names, np.concatenate(held), np.cumsum([0, *map(len, held)])


def runs_of(rows: DataFrame, symbols: Callable[[str | None], np.ndarray], size: int, k: int) -> DataFrame:
    """rows (d long, k long, text) -> (d, k, a, v, at): anchor and content hashes; where the run is, packed by FIELD.

    ``at`` holds the anchor's place, the windows from the first one to it, and those of the run.
    """
    if size - k >= 1 << FIELD:
        raise ValueError(f"windows may have at most {(1 << FIELD) - 1} symbols more than an anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, key = b.column(0).to_numpy(), b.column(1).to_numpy()
            for names, sym, starts in _pieces(map(symbols, b.column(2).to_pylist()), size):
                doc, owner, first, last, anchor, content = owned_runs(sym, starts, size, k)
                row, off = np.array([x for x, _ in names])[doc], np.array([x for _, x in names])[doc] - starts[doc]
                at = ((owner + off) << 2 * FIELD) | ((owner - first) << FIELD) | (last - first)
                cols = [d[row], key[row], anchor.view(np.int64), content.view(np.int64), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["d", "k", "a", "v", "at"])

    return rows.mapInArrow(run, "d long, k long, a long, v long, at long")


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column: those that equal a neighbour in it, and the first and last one."""
    held = None  # the last row so far; whether it stays if the next one differs
    stays = True
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks()
        key = t.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.zeros(len(key), bool)
        keep[0] = stays
        keep[1:] |= same
        keep[:-1] |= same
        yield from t.slice(0, len(key) - 1).filter(pa.array(keep[:-1])).to_batches()
        held, stays = t.slice(len(key) - 1).combine_chunks().to_batches()[0], bool(keep[-1])
    if held is not None:
        yield held


def _contexts(symbols: Callable[[str | None], np.ndarray], size: int, gram: int, width: int):
    """Symbols of each context's windows: from d, k, text, runs to rows of CONTEXT.  A repeated row is read once."""
    kind = {1: np.uint8, 8: np.uint64}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            for i in range(b.num_rows):
                row = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if row == before:
                    continue
                before = row
                raw = symbols(b.column(2)[i].as_py()).astype(kind).tobytes()
                runs = b.column(3)[i].values
                at = runs.field("at").to_numpy()
                first, place = (at >> 2 * FIELD) - ((at >> FIELD) & ((1 << FIELD) - 1)), (at >> FIELD) & ((1 << FIELD) - 1)
                last = first + (at & ((1 << FIELD) - 1))
                s = [raw[x:y] for x, y in zip((first * width).tolist(), ((last + size) * width).tolist())]
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [runs.field("a"), runs.field("v"), *(pa.array(np.full(n, x, np.int64)) for x in row), pa.array(place.astype(np.int32)), pa.array(np.full(n, gram, np.int32)), *(runs.field(c) for c in ("n", "least", "most", "m")), pa.array(s, pa.binary())],
                    names=["a", "v", "d", "k", "place", "gram", "n", "least", "most", "m", "s"],
                )

    return run


def whole_groups(batches: Iterator[pa.RecordBatch], target: int = BATCH) -> Iterator[pa.Table]:
    """Tables of about ``target`` bytes of whole groups of rows sorted by (a, v), each (a, v) once."""
    held: list[pa.RecordBatch] = []
    total = 0

    def single(t: pa.Table) -> pa.Table:
        a, v = t.column("a").to_numpy(), t.column("v").to_numpy()
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (v[1:] != v[:-1])
        return t if new.all() else t.filter(pa.array(new))

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        total += b.nbytes
        if total >= target:
            t = single(pa.Table.from_batches(held).combine_chunks())
            a = t.column("a").to_numpy()
            cut = int(np.searchsorted(a, a[-1])) if a[-1] != a[0] else 0
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            total = sum(x.nbytes for x in held)
    if held:
        yield single(pa.Table.from_batches(held).combine_chunks())


def halves(size: int, width: int):
    """Each context as one or two of a longer anchor: CONTEXT's columns, and the a, v of the whole and the half's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                s, p, g = r["s"], r["place"], r["gram"]
                last, h = len(s) // width - size, (size - g + 2) // 2
                parts = [(0, min(last, p - h), p - h, g + h)] if p >= h else []
                if last > p - h:
                    parts.append((max(0, p - h + 1), last, p, size - h + 1))
                for f, e, at, gram in parts:
                    sub = s[f * width : (e + size) * width]
                    a = xxhash.xxh64_intdigest(s[at * width : (at + gram) * width], seed=r["a"] & 0xFFFFFFFF)
                    v = xxhash.xxh64_intdigest(sub, seed=at - f)
                    signed = [x - (1 << 64) if x >> 63 else x for x in (a, v)]
                    out.append((*signed, r["d"], r["k"], at - f, gram, r["n"], r["least"], r["most"], sub, r["a"], r["v"], f))
            cols = [*zip(*out)] or [[]] * 13
            kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["a", "v", "d", "k", "place", "gram", "n", "least", "most", "s", "a0", "v0", "off"])

    return run


def found_in(contexts: DataFrame, size: int, compare, width: int) -> DataFrame:
    """(a, v, s, e, least): ranges of symbols of contexts that compare finds, and the least document that has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            row, first, last, least = compare(t, size)
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(t.column("a").to_numpy()[row]), pa.array(t.column("v").to_numpy()[row]), pa.array(first.astype(np.int32)), pa.array((last + size).astype(np.int32)), pa.array(least)],
                    names=["a", "v", "s", "e", "least"],
                )

    whole = F.col("gram") >= size  # nothing left to split by: such contexts are equal
    small = contexts.where((F.col("m") <= GROUP) | whole).repartition("a").sortWithinPartitions("a", "v")
    found = materialize(small.mapInArrow(run, "a long, v long, s int, e int, least long"))
    large = contexts.where((F.col("m") > GROUP) & ~whole)
    if large.isEmpty():
        return found
    parts = materialize(large.mapInArrow(halves(size, width), CONTEXT.replace("m long, ", "") + ", a0 long, v0 long, off int"))
    inner = parts.groupBy("a", "v").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.min(F.struct("d", "k", "place", "gram", "s")).alias("one"))
    sizes = inner.groupBy("a").agg(F.count("*").alias("m"))
    inner = materialize(inner.hint("merge").join(sizes, "a").select("a", "v", "one.d", "one.k", "one.place", "one.gram", "n", "least", "most", "m", "one.s"))
    deeper = found_in(inner, size, compare, width)
    home = parts.select("a", "v", "a0", "v0", "off").hint("merge").join(deeper, ["a", "v"])
    back = materialize(home.select(F.col("a0").alias("a"), F.col("v0").alias("v"), (F.col("s") + F.col("off")).alias("s"), (F.col("e") + F.col("off")).alias("e"), "least"))
    discard(parts)
    discard(inner)
    discard(deeper)
    return found.unionByName(back)


def repeated_spans(rows: DataFrame, symbols: Callable[[str | None], np.ndarray], size: int, k: int, earlier: bool, compare, width: int) -> DataFrame:
    """rows (d, k, text) -> (d, k, spans array<struct<s,e>>): ranges of symbols covered by windows that occur again.

    Occur again: start anywhere else (``earlier`` false), or in a row of smaller d.  compare(contexts, size) takes
    whole groups of contexts (sorted by anchor, n runs each) and gives ranges of windows (row, first, last, least): the
    windows of the context in that row that are worth removing from a run whose document is greater than ``least``.
    """
    occ = materialize(runs_of(rows, symbols, size, k))
    # input partitions spread a hot anchor's rows, equal ones too, over ranges
    dealt = occ.select("a", "v", "d", "k", "at", F.spark_partition_id().alias("p")).repartitionByRange("a", "p").sortWithinPartitions("a").drop("p")
    some = materialize(dealt.mapInArrow(neighbours, "a long, v long, d long, k long, at long"))
    discard(occ)
    kinds = some.groupBy("a", "v").agg(F.count("*").alias("n"), F.min(F.struct("d", "k", "at")).alias("one"), F.max("d").alias("most"))
    kinds = materialize(kinds)
    there = F.min("one.d") < F.max("most") if earlier else F.sum("n") > 1
    groups = kinds.groupBy("a").agg(F.count("*").alias("m"), there.alias("there")).where("there").drop("there")
    heads = kinds.hint("merge").join(groups, "a").select("a", "v", "one.*", "n", F.col("one.d").alias("least"), "most", "m")
    wanted = heads.groupBy("d", "k").agg(F.collect_list(F.struct("a", "v", "at", "n", "least", "most", "m")).alias("runs"))
    contexts = rows.hint("merge").join(wanted, ["d", "k"]).select("d", "k", "text", "runs")
    contexts = materialize(contexts.mapInArrow(_contexts(symbols, size, k, width), CONTEXT))
    discard(kinds)
    found = found_in(contexts, size, compare, width)
    hits = some.hint("merge").join(found, ["a", "v"])
    if earlier:
        hits = hits.where(F.col("least") < F.col("d"))
    part = F.lit((1 << FIELD) - 1)
    start = F.shiftright("at", 2 * FIELD) - F.shiftright("at", FIELD).bitwiseAND(part)
    spans = hits.select("d", "k", (start + F.col("s")).alias("s"), (start + F.col("e")).alias("e"))
    spans = materialize(spans.groupBy("d", "k").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")))
    for t in (some, contexts, found):
        discard(t)
    return spans


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Sorted ranges, those that touch as one."""
    out: list[tuple[int, int]] = []
    for x in spans or []:
        s, e = x["s"], x["e"]
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out
