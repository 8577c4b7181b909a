"""Hard-negative mining: the kth best score of every window by distributed radix selection.

Components are scaled and floored, so scores are integers.  A window is (anchor, range of scores, k): an anchor's positives
come from one window over its own label, its negatives from one window for each positive over the other labels.  In every
round each open window counts its candidates in up to 256 buckets of its range of scores; summed over all blocks of rows, the
bucket that holds the kth best becomes the range of the next round.  Where a single score is left that more rows share than
GATHER, the digits of the id (the order of ties) follow.  Then only rows that are better than the last bucket, and that
bucket's, are gathered: k and GATHER a window at most, besides rows that agree in score and id.

Anchors and rows meet in blocks of BLOCK by BLOCK: each anchor goes to all blocks of rows and each row to all blocks of
anchors, and a block pair is scored by one matrix product.  A block sends, of each window, only the counts of its best
buckets that hold k rows: the kth best of all is no worse than the kth best of a block.  Windows stay in tables; the
driver sees single rows.  A label that a third of all rows have, or a vector that they share, is dealt over blocks as any other.

Rows with a null id or label, a null vector, or a null or non-finite component take no part; vectors of another length than
the anchor's are no candidates for it.  Repeated rows each count, as anchors too.  Vectors whose scores could pass 2**62
are an ArithmeticError.  No rows, or no anchors, give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm.common import discard, materialize

#: Rows and anchors of a block; windows scored at a time; bits of a digit; rows of a bucket that are gathered.
BLOCK, CHUNK, BITS, GATHER = 4096, 256, 8, 64
KEY = ["rid", "pr"]
STATE = "rid long, pr long, k long, need long, top long, slo long, shi long, ilo long, ihi long, open boolean"


def _packed(scale: int, kind: str) -> Callable:
    """Rows (rid, id, label, v, anchor) with the vector as the bytes of its scaled, floored components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            x = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale).astype(kind)
            size = np.asarray(v.value_lengths()) * x.itemsize
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("rid", "id", "label", "anchor")] + [packed], names=["rid", "id", "label", "anchor", "x"])

    return run


def _long(t: pa.Table, c: str) -> np.ndarray:
    return t.column(c).to_numpy()


def _scored(windows: pa.Table, rows: pa.Table, kind: str, exact: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(windows, rows, scores of each by each, which rows are candidates by label and length), some windows at a time."""
    labels = pa.concat_arrays([c for t in (windows, rows) for c in t.column("label").chunks]).dictionary_encode().indices.to_numpy()
    wl, rl = labels[: windows.num_rows], labels[windows.num_rows :]
    wx, rx = (t.column("x").to_pylist() for t in (windows, rows))
    wd, rd = (np.array([len(x) for x in xs]) for xs in (wx, rx))
    wr, rr = _long(windows, "rid"), _long(rows, "rid")
    width = np.dtype(kind).itemsize
    for d in np.unique(wd).tolist():
        at, among = np.flatnonzero(wd == d), np.flatnonzero(rd == d)
        if not len(among):
            continue
        matrix = lambda xs, where: np.frombuffer(b"".join([xs[i] for i in where]), kind).reshape(len(where), d // width).astype(np.float64 if exact else np.int64)
        y = matrix(rx, among).T
        at = at[np.argsort(wr[at], kind="stable")]
        for s in range(0, len(at), CHUNK):
            w = at[s : s + CHUNK]
            _, first, each = np.unique(wr[w], return_index=True, return_inverse=True)
            score = (matrix(wx, w[first]) @ y).astype(np.int64)[each]
            yield w, among, score, (wl[w][:, None] == rl[among][None]) == same if not same else (wl[w][:, None] == rl[among][None]) & (wr[w][:, None] != rr[among][None])


def _shift(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """How many bits to drop so that places in [lo, hi] fall into 2**BITS buckets."""
    return np.array([max(int(h - l).bit_length() - BITS, 0) for l, h in zip(lo.tolist(), hi.tolist())], np.int64)


def _counts(kind: str, exact: bool, same: bool) -> Callable:
    """Per open window: rows in each bucket, from the best on, until there are as many as it needs."""

    def run(windows: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if windows.num_rows and rows.num_rows:
            need, slo, shi, ilo, ihi, rid, pr = (_long(windows, c) for c in ("need", "slo", "shi", "ilo", "ihi", "rid", "pr"))
            by_id = slo == shi
            shift = np.where(by_id, _shift(ilo, ihi), _shift(slo, shi))
            ids = _long(rows, "id")
            for w, among, score, ok in _scored(windows, rows, kind, exact, same):
                col = lambda a: a[w][:, None]
                ok &= (score >= col(slo)) & (score <= col(shi))
                place = col(shi) - score
                if by_id[w].any():
                    i = ids[among][None]
                    ok &= ~col(by_id) | ((i >= col(ilo)) & (i <= col(ihi)))
                    place = np.where(col(by_id), i.view(np.uint64) - col(ilo).view(np.uint64), np.where(ok, place, 0).view(np.uint64))
                    bucket = (place >> col(shift).view(np.uint64)).view(np.int64)
                else:
                    bucket = place >> col(shift)
                a, b = np.nonzero(ok)
                n = np.bincount((a << BITS) + bucket[a, b], minlength=len(w) << BITS).reshape(len(w), 1 << BITS)
                a, b = np.nonzero((n > 0) & (np.cumsum(n, axis=1) - n < col(need)))
                out.append([rid[w[a]], pr[w[a]], shift[w[a]], b, n[a, b]])
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["rid", "pr", "shift", "b", "n"])

    return run


def _gathered(kind: str, exact: bool, same: bool) -> Callable:
    """Per window: its best k rows of the block among those that are better than its last bucket or in it."""

    def run(windows: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if windows.num_rows and rows.num_rows:
            k, top, slo, shi, ihi, rid, pr = (_long(windows, c) for c in ("k", "top", "slo", "shi", "ihi", "rid", "pr"))
            ids = _long(rows, "id")
            for w, among, score, ok in _scored(windows, rows, kind, exact, same):
                col = lambda a: a[w][:, None]
                i = ids[among][None]
                ok &= (score <= col(top)) & ((score > col(shi)) | ((score >= col(slo)) & (i <= col(ihi))))
                a, b = np.nonzero(ok)
                s, i = score[a, b], ids[among[b]]
                order = np.lexsort((i, -s, a))
                a, s, i = a[order], s[order], i[order]
                nth = np.arange(len(a)) - np.searchsorted(a, a)
                best = nth < k[w[a]]
                a, s, i = a[best], s[best], i[best]
                out.append([rid[w[a]], pr[w[a]], s, i])
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["rid", "pr", "score", "id"])

    return run


class _Blocks:
    """The rows in blocks, and how windows of anchors meet them."""

    def __init__(self, rows: DataFrame, n: int, anchors: int, kind: str, exact: bool):
        self.rows, self.kind, self.exact = rows, kind, exact
        self.va, self.aa = max(-(-n // BLOCK), 1), max(-(-anchors // BLOCK), 1)
        self.parts = min(self.va * self.aa, 20_000)

    def meet(self, windows: DataFrame, work: Callable, schema: str, same: bool) -> DataFrame:
        deal = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(k)).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
        anchors = windows.join(self.rows.where("anchor").select("rid", F.col("label").alias("label"), F.col("x").alias("x")), "rid")
        left = anchors.withColumn("ab", deal(1, self.aa)).withColumn("vb", every(self.va)).repartition(self.parts, "ab", "vb")
        right = self.rows.select("rid", "id", "label", "x").withColumn("vb", deal(2, self.va)).withColumn("ab", every(self.aa)).repartition(self.parts, "ab", "vb")
        return left.groupBy("ab", "vb").cogroup(right.groupBy("ab", "vb")).applyInArrow(work(self.kind, self.exact, same), schema)


def _narrowed(windows: DataFrame, found: DataFrame) -> DataFrame:
    """Open windows with the bucket that holds their kth best as their range; those without a candidate go."""
    per = found.groupBy(*KEY, "shift", "b").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*KEY).orderBy("b"))
    j = windows.join(per.withColumn("cum", upto), KEY)
    hit = F.struct("b", "n", (F.col("cum") - F.col("n")).alias("before"))
    state = [c for c in windows.columns if c not in KEY]
    g = j.groupBy(*KEY).agg(*(F.first(c).alias(c) for c in state), F.first("shift").alias("shift"), F.min(F.when(F.col("cum") >= F.col("need"), hit)).alias("hit"), F.max("cum").alias("all"))
    dec = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("shift").cast("int"))
    moved = dec("hit.b") * dec(one)
    by_id, sure = F.col("slo") == F.col("shi"), F.col("hit").isNotNull()
    shi = F.when(sure & ~by_id, (dec("shi") - moved).cast("long")).otherwise(F.col("shi"))
    slo = F.when(sure & ~by_id, F.greatest(dec("slo"), dec("shi") - moved - dec(one) + 1).cast("long")).otherwise(F.col("slo"))
    ilo = F.when(sure & by_id, (dec("ilo") + moved).cast("long")).otherwise(F.col("ilo"))
    ihi = F.when(sure & by_id, F.least(dec("ihi"), dec("ilo") + moved + dec(one) - 1).cast("long")).otherwise(F.col("ihi"))
    need = F.when(sure, F.col("need") - F.col("hit.before")).otherwise(F.col("need"))
    left = F.when(sure, F.col("hit.n")).otherwise(0)
    out = g.select(*KEY, "k", need.alias("need"), "top", slo.alias("slo"), shi.alias("shi"), ilo.alias("ilo"), ihi.alias("ihi"), left.alias("left"))
    return out.withColumn("open", (F.col("left") > GATHER) & ((F.col("slo") < F.col("shi")) | (F.col("ilo") < F.col("ihi")))).drop("left")


def _selected(blocks: _Blocks, windows: DataFrame, same: bool) -> DataFrame:
    """(rid, pr, id, score, rank): the first k rows of every window, by score descending and id."""
    windows = materialize(windows)
    done = []
    while True:
        is_open = windows.where("open")
        if is_open.isEmpty():
            break
        found = blocks.meet(is_open, _counts, "rid long, pr long, shift long, b long, n long", same)
        new = materialize(_narrowed(is_open, found))
        done.append(windows)
        windows = materialize(windows.where("not open").unionByName(new))
        done.append(new)
    best = blocks.meet(windows, _gathered, "rid long, pr long, score long, id long", same).groupBy(*KEY, "score", "id").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEY).orderBy(F.desc("score"), "id")
    j = best.withColumn("before", F.sum("n").over(w) - F.col("n")).join(windows.select(*KEY, "k"), KEY).where(F.col("before") < F.col("k"))
    j = j.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.least(F.col("before") + F.col("n"), "k"))))
    out = materialize(j.select(*KEY, "id", "score", F.col("rank").cast("int").alias("rank")))
    for t in (*done, windows):
        discard(t)
    return out


def mine_negatives(vectors: DataFrame, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor (a row where ``anchor`` holds) has as positives its best ``positives`` other rows of its label.  For each, the
    best ``negatives`` rows of other labels whose score is from ``low`` to ``high`` per cent of the positive's.
    """
    if not 0 < low <= high:
        raise ValueError("low and high must be per cents, low not above high")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + F.pow(F.abs(x) * scale + 1, 2))
    s = rows.agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"), F.max(square).alias("most"), F.min("id").alias("ilo"), F.max("id").alias("ihi")).first()
    if not s.n or not s.anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not s.most < 2**62:
        raise ArithmeticError("scores of these vectors can pass 2**62")
    most = int(s.most)
    kind = next(k for k, bits in (("<i2", 30), ("<i4", 62)) if most < 1 << bits)
    label = rows.schema["label"].dataType.simpleString()
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    rows = materialize(rows.mapInArrow(_packed(scale, kind), f"rid long, id long, label {label}, anchor boolean, x binary"))
    blocks = _Blocks(rows, s.n, s.anchors, kind, most < 2**53)

    def windows(df: DataFrame, k: int, lo: Column, hi: Column, pr: Column) -> DataFrame:
        n = lambda x: F.lit(x).cast("long")
        return df.select("rid", pr.cast("long").alias("pr"), n(k).alias("k"), n(k).alias("need"), hi.alias("top"), lo.alias("slo"), hi.alias("shi"), n(s.ilo).alias("ilo"), n(s.ihi).alias("ihi"), F.lit(True).alias("open"))

    bound = lambda x: F.lit(x).cast("long")
    pos = _selected(blocks, windows(rows.where("anchor"), positives, bound(-most), bound(most), F.lit(0)), same=True)
    pos = pos.select("rid", F.col("rank").cast("long").alias("pr"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    of = lambda per, up: F.call_function("div", F.col("positive_score").cast("decimal(38,0)") * per + up, F.lit(100)).cast("long")
    neg = _selected(blocks, windows(pos.where("positive_score >= 0"), negatives, of(low, 99), of(high, 0), F.col("pr")).where("slo <= shi"), same=False)
    ids = rows.where("anchor").select("rid", F.col("id").alias("anchor_id"))
    out = neg.join(pos, KEY).join(ids, "rid")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
