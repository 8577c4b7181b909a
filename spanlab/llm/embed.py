"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors of cosine c are at squared distance 2 - 2c.  After a random rotation, split into m blocks of coordinates:
if two vectors are within budget B in all, some block of theirs is within B * (its share of the coordinates).  Each
block is range-joined by a grid over its first coordinates (cell side twice the block's radius; a vector also visits
the greater cells that its radius reaches), and the block's whole distance is tested in the cell.

Rows of cells carry the whole rotated vector in single precision, so a cell decides its candidates at once: of all blocks
the relatively nearest owns a pair, and two vectors meet in one cell of it, so each pair is counted once and no list of
pairs is written.  A cell writes how many vectors each of its rows links with and the links that join components, both at
most in proportion to its rows; a cell of more than CHUNK rows is worked in pairs of parts, each of which writes so much.
Only pairs whose squared distance is within MARGIN of the budget, more than the rounding can
move it, are written and verified on the original vectors in double precision.

Equal vectors of one label are one class from the start, so a vector that a third of all rows share is one row of the
join.  Cells of any size are worked in blocks (see pairs.py).  A row that can link with nothing - null label, null or
zero vector, null or non-finite component - is its own component.  Vectors of unlike length never link.  Repeated rows
and null ids count as vectors; a component's id is the least id that is not null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import connected_components, discard, materialize
from spanlab.llm.pairs import in_blocks

BLOCKS, GRID, SEED = 8, 3, 20_240_117
SLACK = 1e-9
#: Rounding unit vectors to single precision moves a squared distance by less than 5e-7.
MARGIN = 1e-6
#: Blocks whose distances over their shares agree to this are equally near.
QUANTUM = 1e-6
CELL_BITS = 20
#: Rows of a part of a crowded cell, and pairs measured at a time.
CHUNK, PAIRS = 4096, 65_536
EDGE, CLOSE, COUNT = 0, 1, 2


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unscaled(x: np.ndarray) -> np.ndarray:
    """Rows brought to a largest component of 1/2 to 1 by powers of two, which rounds nothing: squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _spans(dim: int, blocks: int) -> list[slice]:
    """The blocks of coordinates."""
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _reach(budget: float, share: float) -> float:
    """The greatest distance that a block of this share of the coordinates can have if it owns a pair."""
    return float(np.sqrt((budget + MARGIN + QUANTUM) * share)) + SLACK


def _cells(x: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, their cells, home): each row's own cell, then the greater ones that it reaches."""
    g = min(GRID, x.shape[1])
    home, low, high = (np.floor((x[:, :g] + by) / (2 * radius)).astype(np.int64) for by in (0, -radius, radius))
    for step in itertools.product((-1, 0, 1), repeat=g):
        if step < (0,) * g:
            continue
        cell = home + np.array(step)
        rows = np.flatnonzero(((low <= cell) & (cell <= high)).all(axis=1))
        packed = np.zeros(len(rows), np.int64)
        for d in range(g):
            packed = (packed << CELL_BITS) + (cell[rows, d] + (1 << CELL_BITS - 1))
        yield rows, packed, not any(step)


def _scatter(budget: float, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                vectors = part.column(3).to_pylist()
                length = np.array([len(v) for v in vectors])
                for dim in np.unique(length).tolist():
                    own = np.flatnonzero(length == dim)
                    x = unscaled(np.array([vectors[i] for i in own], np.float64))
                    x = ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(dim)).astype(np.float32)
                    packed = pa.array([r.tobytes() for r in x], pa.binary())
                    rows = part.take(pa.array(own))
                    for k, cols in enumerate(_spans(dim, blocks)):
                        for i, cell, home in _cells(x[:, cols].astype(np.float64), _reach(budget, (cols.stop - cols.start) / dim)):
                            if len(i):
                                at = pa.array(i)
                                yield pa.RecordBatch.from_arrays(
                                    [rows.column(1).take(at), pa.array(np.full(len(i), dim, np.int32)), pa.array(np.full(len(i), k, np.int32)), pa.array(cell), rows.column(0).take(at), rows.column(2).take(at), pa.array(np.full(len(i), home)), packed.take(at)],
                                    names=["label", "dim", "block", "cell", "cid", "mult", "home", "x"],
                                )

    return run


def joining(i: np.ndarray, j: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Positions of pairs (i, j) that join components; up, each node's root, is brought up to date."""
    kept = []
    at = np.arange(len(i))
    while True:
        a, b = up[i[at]], up[j[at]]
        at, a, b = at[a != b], a[a != b], b[a != b]
        if not len(at):
            return np.concatenate(kept) if kept else at
        low, high = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]  # each root is hooked once, to a lesser one
        kept.append(at[first])
        hook = np.arange(len(up))
        hook[high[first]] = low[first]
        while (hook[hook] != hook).any():
            hook = hook[hook]
        up[:] = hook[up]


def _near(budget: float, blocks: int):
    """Per block of a cell: how many vectors each links with, the links that join components, and the pairs too close to call."""

    def find(t: pa.Table, cross: bool) -> pa.RecordBatch | None:
        dim, block = t.column("dim")[0].as_py(), t.column("block")[0].as_py()
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(t.num_rows, dim).astype(np.float64)
        cid, mult, home, c = (t.column(n).to_numpy() for n in ("cid", "mult", "home", "__c"))
        spans = _spans(dim, blocks)
        share = np.array([s.stop - s.start for s in spans]) / dim
        y = np.ascontiguousarray(x[:, spans[block]])
        most = _reach(budget, share[block]) ** 2 + 1e-9
        sq = (y * y).sum(axis=1)
        h = np.flatnonzero(home)
        up, links = np.arange(t.num_rows), np.zeros(t.num_rows, np.int64)
        edges, close = [], []
        for s in range(0, len(h), 512):
            rows = h[s : s + 512]
            near = sq[rows][:, None] + sq[None] - 2 * (y[rows] @ y.T) <= most
            near &= ~home[None] | (cid[rows][:, None] < cid[None])
            if cross:
                near &= c[rows][:, None] != c[None]
            first, second = np.nonzero(near)
            first = rows[first]
            for p in range(0, len(first), PAIRS):
                i, j = first[p : p + PAIRS], second[p : p + PAIRS]
                part = np.add.reduceat((x[i] - x[j]) ** 2, [z.start for z in spans], axis=1)
                # the same bytes in every block, so each pair has one owner
                mine = np.argmin(np.floor(part / share / QUANTUM), axis=1) == block
                far = part.sum(axis=1) - budget
                sure, open_ = mine & (far < -MARGIN), mine & (np.abs(far) <= MARGIN)
                close.append(np.stack([cid[i[open_]], cid[j[open_]]]))
                i, j = i[sure], j[sure]
                np.add.at(links, i, mult[j])
                np.add.at(links, j, mult[i])
                new = joining(i, j, up)
                edges.append(np.stack([cid[i[new]], cid[j[new]]]))
        if not edges:
            return None
        edges, close = np.concatenate(edges, axis=1), np.concatenate(close, axis=1)
        some = np.flatnonzero(links)
        a = np.concatenate([edges[0], close[0], cid[some]])
        b = np.concatenate([edges[1], close[1], links[some]])
        kind = np.repeat(np.array([EDGE, CLOSE, COUNT], np.int32), [edges.shape[1], close.shape[1], len(some)])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return find


def near_vectors(vectors: DataFrame, min_cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", blocks: int = BLOCKS) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.  Other columns are dropped."""
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must be in (0, 1]")
    budget = 2 - 2 * min_cosine
    label = F.col(label_col) if label_col else F.lit(0)
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    valid, rest = rows.where(good), rows.where(~good)
    classes = valid.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    scattered = classes.select("cid", "label", "mult", "v").mapInArrow(
        _scatter(budget, blocks), f"label {classes.schema['label'].dataType.simpleString()}, dim int, block int, cell long, cid long, mult long, home boolean, x binary"
    )
    found = materialize(in_blocks(scattered, ["label", "dim", "block", "cell"], "cid", _near(budget, blocks), "kind int, a long, b long", CHUNK))

    @F.pandas_udf("double")
    def cosine(p, q):
        import pandas as pd

        out, n = np.zeros(len(p)), p.map(len).to_numpy(int)
        for dim in np.unique(n):
            x, y = (unscaled(np.stack(c[n == dim].to_list())) for c in (p, q))
            dot = lambda a, b: np.einsum("ij,ij->i", a, b)
            out[n == dim] = dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))
        return pd.Series(out)

    side = lambda n, v, m: classes.select(F.col("cid").alias(n), F.col("v").alias(v), F.col("mult").alias(m))
    close = found.where(F.col("kind") == CLOSE).select("a", "b").join(side("a", "p", "ma"), "a").join(side("b", "q", "mb"), "b")
    close = materialize(close.where(cosine("p", "q") >= min_cosine).select("a", "b", "ma", "mb"))
    counts = found.where(F.col("kind") == COUNT).select("a", F.col("b").alias("n"))
    counts = counts.unionByName(close.select("a", F.col("mb").alias("n"))).unionByName(close.select(F.col("b").alias("a"), F.col("ma").alias("n")))
    degree = counts.groupBy("a").agg(F.sum("n").alias("links"))
    edges = found.where(F.col("kind") == EDGE).select("a", "b").unionByName(close.select("a", "b"))
    comp = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(comp, classes.cid == comp.node, "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").join(degree, named.cid == degree.a, "left")
    named = materialize(named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"))
    for t in (classes, found, close):
        discard(t)
    out = valid.join(named, ["label", "v"]).select("id", "n_links", "component_id")
    out = out.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
