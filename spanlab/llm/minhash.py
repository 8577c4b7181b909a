"""MinHash near-dedup with circulant permutations, banding and exact verification.

A document's set is that of its distinct word shingles.  One permutation (sigma, a hash) places the shingles on a
circle of D places; a second one (pi, a fixed table) is shifted by one place for each of the K signature coordinates:
coordinate j is the least pi[(s + j) mod D] over the places s.  The window of K neighbours of a place is one
contiguous read, so a shingle costs one look-up for the whole signature.

Documents of equal sets are one class from the start.  In every bucket of every band the least class is a leader;
pairs (leader, member) are verified on full sets and joined to components.  A second pass takes every bucket that still
holds several components, with full sets and signatures, in blocks of bounded size: all pairs across components whose sizes
allow a link are verified, likely ones (by their signatures) first, until the block's components are joined or shown
apart.  So no group's pairs are listed, and a link between components is not
lost to the leader's choice.

With 16 bands of 4 a pair at similarity 0.8 shares no bucket with probability 2e-4, at 0.85 6e-6.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import connected_components, discard, materialize, working_names
from spanlab.llm.pairs import in_blocks

PLACES_LOG2, BANDS, ROWS = 22, 16, 4
K = BANDS * ROWS
SEED = 7
#: Stands for a null id in keys.
NO_ID = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+, A-Z lower-cased."""
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """The set of shingle hashes, sorted.  Fewer words than size: the whole sequence as one; no words: empty."""
    w = word_hashes(text)
    n = len(w)
    if not n:
        return w
    short = min(n, size)
    h = np.full(n - short + 1, short, np.uint64)
    for k in range(short):
        h = mix(h + w[k : n - short + 1 + k])
    return np.unique(h)


@lru_cache(maxsize=1)
def circle() -> np.ndarray:
    pi = np.random.default_rng(SEED).permutation(1 << PLACES_LOG2).astype(np.uint32)
    return sliding_window_view(np.concatenate([pi, pi[:K]]), K)


def signature(s: np.ndarray) -> np.ndarray:
    places = mix(s ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PLACES_LOG2)
    out = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(places), 8192):
        np.minimum(out, circle()[places[i : i + 8192]].min(axis=0), out=out)
    return out


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, sig = [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, size)
                n.append(len(s))
                digest.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["d", "k", "n", "digest", "sig"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shingles(t, size).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["cid", "sig", "s"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _across(percent: int):
    """Links across the components of one bucket's block, no more than it takes to join them.

    Likely pairs come first; a pair whose ends the block has joined already is not verified again.
    """

    def find(t: pa.Table, cross: bool) -> pa.RecordBatch | None:
        rows, band = t.num_rows, t.column("band")[0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in t.column("s").to_pylist()]
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(rows, K)
        cid, comp, n, c = (t.column(x).to_numpy() for x in ("cid", "comp", "n", "__c"))
        first, second, agree = [], [], []
        for i in range(rows - 1):
            ok = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
            if cross:
                ok &= c[i + 1 :] != c[i]
            j = np.flatnonzero(ok) + i + 1
            same = sig[j] == sig[i]
            total = same.sum(axis=1)
            if band and len(j):  # a pair that shares an earlier band is looked at there
                own = ~same[:, : band * ROWS].reshape(len(j), band, ROWS).all(axis=2).any(axis=1)
                j, total = j[own], total[own]
            first.append(np.full(len(j), i))
            second.append(j)
            agree.append(total)
        if not first:
            return None
        order = np.argsort(-np.concatenate(agree), kind="stable")
        first, second = np.concatenate(first)[order], np.concatenate(second)[order]
        up = {x: x for x in comp.tolist()}

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        found = []
        for i, j in zip(first.tolist(), second.tolist()):
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x != y and _linked(sets[i], sets[j], percent):
                up[max(x, y)] = min(x, y)
                found.append((int(cid[i]), int(cid[j])))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    return find


def near_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: d (the id), k (the text's hash), n_shingles, component_id, kept, first.

    Links: 100 * intersection >= percent * union of the sets of ``size``-word shingles, A-Z lower-cased.  A document
    without words links with nothing.  component_id is the least id that links reach; a null id counts as none, and
    a component of null ids has a null id.  Repeated rows and rows that share an id are documents of their own that
    link as any others.  ``first`` marks the least (id, text hash) of a component: repeated rows apart, one row.
    """
    sketch = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k"), F.col(text_col).alias("text"))
    sketch = materialize(sketch.mapInArrow(_sketch(size), "d long, k long, n long, digest binary, sig binary"))
    some = sketch.where("n > 0")
    classes = some.groupBy("digest").agg(F.min(F.struct(F.coalesce("d", F.lit(NO_ID)).alias("d"), "k")).alias("row"), F.min("d").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    keys = F.array(*(F.xxhash64(F.lit(b), F.substring("sig", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)))
    bands = classes.select("cid", "n", F.posexplode(keys).alias("band", "key"))
    leaders = bands.groupBy("band", "key").agg(F.min("cid").alias("lead"), F.max("cid").alias("last"), F.min_by("n", "cid").alias("lead_n")).where("lead < last").drop("last")
    shared = materialize(bands.join(materialize(leaders), ["band", "key"]))  # apart from the sums, a join that a hot bucket's rows may split
    fits = F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent
    stars = shared.where(F.col("cid") != F.col("lead")).where(fits).select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct()

    wanted = shared.select("cid").distinct().join(classes.select("cid", "row.d", "row.k", "sig"), "cid")
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("k"), F.col(text_col).alias("text"))
    sets = materialize(keyed.join(wanted, ["d", "k"]).select("cid", "sig", "text").mapInArrow(_sets(size), "cid long, sig binary, s binary"))

    @F.pandas_udf("boolean")
    def linked(p, q):
        return p.combine(q, lambda x, y: _linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)).astype(bool)

    def verified(pairs: DataFrame) -> DataFrame:
        s = pairs.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("p")), "a").join(sets.select(F.col("cid").alias("b"), F.col("s").alias("q")), "b")
        return materialize(s.where(linked("p", "q")).select(F.col("a").alias("u"), F.col("b").alias("v")))

    first = verified(stars)
    comp = materialize(connected_components(first))
    placed = shared.select("band", "key", "cid", "n").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band", "key")
    open_rows = placed.join(materialize(mixed), ["band", "key"]).join(sets, "cid").select("band", "key", "cid", "n", "comp", "s", "sig")
    second = in_blocks(open_rows, ["band", "key"], "cid", _across(percent), "u long, v long")

    comp = connected_components(first.unionByName(second))
    for t in (shared, sets, first):
        discard(t)
    named = classes.join(comp, classes.cid == comp.node, "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.min("row").alias("head"))
    named = materialize(named.join(least, "component").select("digest", "component_id", "head"))
    out = sketch.select("d", "k", "n", "digest").join(named, "digest", "left")
    comp_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("d"))
    first = F.when(F.col("n") > 0, F.struct(F.coalesce("d", F.lit(NO_ID)).alias("d"), "k") == F.col("head")).otherwise(F.lit(True))
    return out.select("d", "k", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.col("d").eqNullSafe(comp_id).alias("kept"), first.alias("first"))


def drop_near_documents(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns in order, with one row of each component (see near_documents), and of repeated rows one.

    Of rows equal in id and text the one whose other columns, hashed, are least stays, so runs agree.
    """
    d, k, h = working_names(docs, "__d", "__k", "__h")
    near = near_documents(docs, size, percent, id_col, text_col).where("first")
    stay = near.select(F.coalesce("d", F.lit(NO_ID)).alias(d), F.col("k").alias(k)).distinct()
    plain = [F.col(f"`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    rows = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), k: F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), h: F.xxhash64(*plain)})
    least = rows.groupBy(d, k).agg(F.min(h).alias(h))  # hashes only travel, combined before the shuffle
    kept = rows.join(stay.join(least, [d, k]), [d, k, h])
    return kept.dropDuplicates([d, k, h]).select(*(f"`{c}`" for c in docs.columns))
