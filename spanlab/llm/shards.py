"""Sharding by histogram sort: rows go to shards of near equal bytes (or of equal row counts) in one exchange.

Rows are ordered by (hash of the text, hash of the id, a number of the row), so equal texts are neighbours and still split
where a boundary falls among them.  Only narrow keys are written and read again: each round counts, over all partitions, the
exact bytes in the cells of every open bracket (one aggregate combined before its shuffle; the driver sees at most SHARDS *
CELLS sums), and keeps for each boundary the one cell that its target lies in.  A boundary is found when the bytes below a
cell's edge are within the tolerance of the target, or when its cell holds a single row.

Then rows are exchanged once: by shard and a part of it, whose size is bounded, and numbered within.  Parts are dealt by
hash of id and row number, so no group of equal texts makes a part large; where a part's slots begin is a running sum over
the counts of parts.

Main path: DataFrame functions only.  Null text counts 0 bytes, null ids are one id; rows of one id and text are alike and
any of them may go to either side.  No rows give no rows.  A row larger than a shard makes its shard larger by that much.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm.common import materialize, working_names

LAWS = ("bytes", "rows")
#: Cells of the first round, and of each bracket in later ones.
FIRST, CELLS = 4096, 256
#: Rows of a part of a shard, about.
ROWS_A_PART = 20_000
TOP = 1 << 63


@dataclass(frozen=True)
class Bracket:
    """Where a boundary lies: key columns equal to ``prefix``, the next one in [lo, hi); ``below`` weighs what is before."""

    prefix: tuple[int, ...] = ()
    lo: int = 0
    hi: int = TOP
    below: int = 0

    def step(self, cells: int) -> int:
        return -(-(self.hi - self.lo) // cells)

    def edge(self, at: int, keys: int) -> tuple[int, ...] | None:
        """The least key at or after value ``at`` of this bracket's column; None is past all keys."""
        if at < TOP:
            return (*self.prefix, at, *[0] * (keys - len(self.prefix) - 1))
        if not self.prefix:
            return None
        return Bracket(self.prefix[:-1]).edge(self.prefix[-1] + 1, keys)


def _at_least(keys: list[Column], edge: tuple[int, ...]) -> Column:
    """keys >= edge in lexicographic order."""
    out = keys[-1] >= edge[-1]
    for k, e in zip(reversed(keys[:-1]), reversed(edge[:-1])):
        out = (k > e) | ((k == e) & out)
    return out


def _histogram(rows: DataFrame, keys: list[str], weight: str, brackets: list[Bracket], cells: int) -> dict[int, tuple[int, int]]:
    """cells * bracket + cell -> (weight, rows), over all rows that lie in a bracket."""
    place = F.lit(None).cast("long")
    for b, x in reversed([*enumerate(brackets)]):
        k = F.col(keys[len(x.prefix)])
        inside = k >= x.lo
        if x.hi < TOP:
            inside = inside & (k < x.hi)
        for c, v in zip(keys, x.prefix):
            inside = inside & (F.col(c) == v)
        cell = F.call_function("div", k - F.lit(x.lo), F.lit(x.step(cells))) + b * cells
        place = F.when(inside, cell).otherwise(place)
    g = rows.select(place.alias("p"), F.col(weight).alias("w")).where("p is not null").groupBy("p").agg(F.sum("w").alias("w"), F.count("*").alias("n"))
    return {r.p: (r.w, r.n) for r in g.collect()}


def _narrowed(x: Bracket, target: int, cells: int, found: dict[int, tuple[int, int]], base: int, tolerance: float, keys: int):
    """The bracket's cell with the target, or the boundary: a key, or None past all."""
    below, step = x.below, x.step(cells)
    for c in range(cells):
        w, n = found.get(base + c, (0, 0))
        lo, hi = x.lo + c * step, min(x.lo + (c + 1) * step, x.hi)
        if not n or below + w < target - tolerance:
            below += w
            continue
        if abs(below - target) <= tolerance or n == 1:
            return ("edge", x.edge(lo if target - below <= below + w - target else hi, keys))
        if abs(below + w - target) <= tolerance:
            return ("edge", x.edge(hi, keys))
        if hi - lo == 1:
            return ("open", Bracket((*x.prefix, lo), 0, TOP, below))
        return ("open", replace(x, lo=lo, hi=hi, below=below))
    return ("edge", x.edge(x.hi, keys))


def boundaries(rows: DataFrame, keys: list[str], weight: str, total: int, shards: int, tolerance: float) -> list[tuple[int, ...] | None]:
    """The keys that begin shards 1 and on.  Key columns hold longs from 0; together they are unlike in every row."""
    open_ = {j: Bracket() for j in range(1, shards)}
    done: dict[int, tuple[int, ...] | None] = {}
    while open_:
        distinct = [*dict.fromkeys(open_.values())]
        cells = FIRST if len(distinct) == 1 else CELLS
        found = _histogram(rows, keys, weight, distinct, cells)
        for j, x in list(open_.items()):
            what, got = _narrowed(x, total * j // shards, cells, found, distinct.index(x) * cells, tolerance, len(keys))
            if what == "edge":
                done[j] = got
                del open_[j]
            else:
                open_[j] = got
    return [done[j] for j in range(1, shards)]


def shard_documents(docs: DataFrame, shards: int = 24, law: str = "bytes", keep: list[str] | None = None, tolerance: float = 1e-4, rows_a_part: int = ROWS_A_PART, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns ``keep`` (None: all of docs) with size (UTF-8 bytes of the text and 8), shard and slot (gapless from 0).

    law ``bytes``: each boundary is within ``tolerance`` of a shard's mean bytes of its place, or as near as whole rows
    allow.  law ``rows``: row counts differ by one at most.  docs' own columns size, shard and slot are replaced.
    """
    if law not in LAWS:
        raise ValueError(f"unknown law {law!r}; one of {LAWS}")
    if shards < 1:
        raise ValueError("there must be at least one shard")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("size", "shard", "slot")]
    k0, k1, k2, w, part, skip = working_names(docs, "__k0", "__k1", "__k2", "__w", "__part", "__skip")
    text = F.coalesce(F.col(text_col), F.lit(""))
    positive = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1)
    size = F.octet_length(text).cast("long") + 8
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), size.alias("size"), positive(text).alias(k0), positive(F.col(id_col)).alias(k1), F.monotonically_increasing_id().alias(k2))
    rows = materialize(rows).withColumn(w, F.col("size") if law == "bytes" else F.lit(1).cast("long"))
    total, n = rows.agg(F.sum(w), F.count("*")).first()
    keys = [k0, k1, k2]
    edges = boundaries(rows, keys, w, total, shards, tolerance * total / shards if law == "bytes" else 0) if n else []
    past = [_at_least([F.col(k) for k in keys], e).cast("int") for e in edges if e is not None]
    parts = max(-(-n // (shards * rows_a_part)), 1)
    placed = rows.withColumn("shard", sum(past, F.lit(0))).withColumn(part, F.pmod(F.xxhash64(k1, k2), F.lit(parts)).cast("int"))
    counts = placed.groupBy("shard", part).agg(F.count("*").alias(w))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", part, F.coalesce(F.sum(w).over(before), F.lit(0)).alias(skip))
    numbered = placed.withColumn("slot", F.row_number().over(Window.partitionBy("shard", part).orderBy(*keys)))
    out = numbered.join(starts, ["shard", part])
    return out.select(*(F.col(f"`{c}`") for c in kept), "size", "shard", (F.col("slot") + F.col(skip) - 1).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet in one folder a shard; rows of a file are in the order of their slots."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
