"""Line dedup: which lines of a document stay, decided over the lines of all documents.

Lines travel as (key hash, document, position) only.  They are range-partitioned by all of these columns, so a key
that a third of all documents hold is spread over as many tasks as its rows need, and sorted within partitions.  Two
streaming passes follow over the same written partitions: the first sums up the keys at a partition's two edges (at
most two rows a partition come to the driver), the second, knowing how such a key goes on elsewhere, decides every
line.  Decisions come back as one zlib-compressed bitmap a document.

A document is an id: rows of one id count once for a line that they share, as does a line that stands in one text twice; all
null ids are one document.  Repeated rows get the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import SPACE, discard, materialize, shared_dir, working_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["h1", "h2", "d", "k", "pos"]
NO_ID = -(1 << 63)
#: Lines that a range holds, about, at most; more ranges are made of more lines.
ROWS_A_PART = 8_000_000


def ascii_lower(text):
    """A-Z lower-cased, all else as it is; for pure ASCII by the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Columns as arrays, each row once: repeated rows are neighbours."""
    last = None
    for b in batches:
        if b.num_rows:
            a = np.stack([c.to_numpy().astype(np.int64) for c in b.columns])
            new = _changes(a)
            new[0] = last is None or (a[:, 0] != last).any()
            last = a[:, -1].copy()
            if new.any():
                yield a[:, new]


def _changes(a: np.ndarray) -> np.ndarray:
    """Where a column of a differs from the one before; the first always does."""
    out = np.ones(a.shape[1], bool)
    out[1:] = (a[:, 1:] != a[:, :-1]).any(axis=0)
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last key of a partition: distinct documents, and the first and last of them."""
    runs: list[list] = []  # [h1, h2, documents, first d, last d]: the first run, and the current one
    for a in _rows(batches):
        at = np.flatnonzero(_changes(a[:2]))
        docs = np.add.reduceat(_changes(a[:3]).astype(np.int64), at)
        ends = np.append(at[1:], a.shape[1]) - 1
        for i in {0, len(at) - 1}:
            s, e = a[:, at[i]], a[:, ends[i]]
            if runs and i == 0 and (runs[-1][0], runs[-1][1]) == (s[0], s[1]):
                r = runs[-1]
                r[2] += docs[0] - (r[4] == s[2])
                r[4] = e[2]
            elif i or len(at) == 1 or not runs:
                runs = runs[:1] + [[s[0], s[1], docs[i], s[2], e[2]]]
    if runs:
        part = TaskContext.get().partitionId()
        cols = [*zip(*([part, *map(int, r)] for r in runs))]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["part", "h1", "h2", "n", "d0", "d1"])


def _merge_edges(rows: list) -> dict[tuple[int, int], tuple[int, int]]:
    """Keys that lie in several partitions: (distinct documents in all, the first partition)."""
    total: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: (r.part, r.h1, r.h2, r.d0)):
        key = (r.h1, r.h2)
        if key in total:
            t = total[key]
            t[0] += r.n - (t[2] == r.d0)
            t[2], t[3] = r.d1, t[3] + 1
        else:
            total[key] = [r.n, r.part, r.d1, 1]
    return {k: (n, part) for k, (n, part, _, parts) in total.items() if parts > 1}


def dropped_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, k, drops): for each document that loses lines its id, text hash and bitmap.

    A line's key is the line without white space at its ends, A-Z lower-cased.  Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose all their lines, or with ``keep_first`` all but the first by
    document and position.  Bit i of the bitmap (zlib over numpy's packed bits) is 1 where line i stays; lines beyond
    its end stay.
    """
    spark = docs.sparkSession
    base = _with_key(docs, id_col, text_col).where(F.length("text") >= min_chars)
    key = F.trim(F.col("line"), F.lit(SPACE))
    lines = (
        base.select("d", "k", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
        .withColumn("key", key).where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "d", "k", "pos")
    )
    lines = materialize(lines)
    shared_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // ROWS_A_PART), 1)
    ordered = lines.repartitionByRange(parts, *KEYS).sortWithinPartitions(*KEYS).checkpoint()
    discard(lines)
    schema = "part long, h1 long, h2 long, n long, d0 long, d1 long"
    carried = _merge_edges(ordered.mapInArrow(_edges, schema).collect())

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that go.  Of a key that goes on, only the rows of its first min_docs documents are held, until it is known to go."""
        part = TaskContext.get().partitionId()
        key, seen, last, held = None, 0, None, []

        def out(a: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in a[2:]], names=["d", "k", "pos"])

        for a in _rows(batches):
            at = np.flatnonzero(_changes(a[:2]))
            docs_of = np.add.reduceat(_changes(a[:3]).astype(np.int64), at)
            goes_on = key == (int(a[0, 0]), int(a[1, 0]))
            if goes_on:
                docs_of[0] += seen - (last == a[2, 0])
            total, first = docs_of.copy(), np.zeros(a.shape[1], bool)
            first[at] = True
            first[0] = not goes_on
            for i in {0, len(at) - 1}:
                if more := carried.get((int(a[0, at[i]]), int(a[1, at[i]]))):
                    total[i] = more[0]
                    first[at[i]] &= more[1] == part
            gone = np.repeat(total >= min_docs, np.diff(np.append(at, a.shape[1])))
            if goes_on and gone[0]:
                for x in held:
                    yield out(x)
                held = []
            stay = first if keep_first else np.zeros(a.shape[1], bool)
            yield out(a[:, gone & ~stay])
            tail = slice(at[-1], None)
            if gone[-1]:
                held = []
            else:
                held = [*(held if goes_on and len(at) == 1 else []), a[:, tail][:, ~stay[tail]]]
            key, seen, last = (int(a[0, -1]), int(a[1, -1])), int(docs_of[-1]), int(a[2, -1])

    @F.pandas_udf("binary")
    def bitmap(positions):
        def one(p):
            keep = np.ones((int(max(p)) // 8 + 1) * 8, bool)
            keep[p] = False
            return zlib.compress(np.packbits(keep).tobytes())

        return positions.map(one)

    drops = ordered.mapInArrow(decide, "d long, k long, pos long")
    return drops.groupBy("d", "k").agg(F.collect_list("pos").alias("p")).select("d", "k", bitmap("p").alias("drops"))


def kept_text(text: str, drops: bytes) -> str:
    """The lines that stay, joined by a newline."""
    keep = np.unpackbits(np.frombuffer(zlib.decompress(drops), np.uint8))
    n = len(keep)
    return "\n".join([x for i, x in enumerate(text.split("\n")) if i >= n or keep[i]])


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs, all columns in order, with the dropped lines gone from text_col and size_col (where it exists) counted anew.

    Null text stays null.  Parameters as for dropped_lines.
    """
    out, kept, _ = _applied(docs, min_docs, keep_first, min_chars, id_col, text_col)
    done = F.coalesce(F.col(kept), F.col(text_col))
    cols = [done.alias(c) if c == text_col else F.length(done).cast(docs.schema[c].dataType).alias(c) if c == size_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)


def _applied(docs: DataFrame, min_docs: int, keep_first: bool, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with two columns more, whose names are returned: the kept text where lines go, and the bitmap."""

    @F.pandas_udf("string")
    def rest(texts, drops):
        return texts.combine(drops, lambda t, d: None if t is None or d is None else kept_text(t, d))

    d, k, lost, kept = working_names(docs, "__d", "__k", "__drops", "__kept")
    drops = dropped_lines(docs, min_docs, keep_first, min_chars, id_col, text_col).select(F.col("d").alias(d), F.col("k").alias(k), F.col("drops").alias(lost))
    keyed = docs.withColumns({d: F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), k: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    joined = keyed.join(drops, [d, k], "left")
    # only texts that lose lines go to Python
    return joined.withColumn(kept, rest(F.when(F.col(lost).isNotNull(), F.col(text_col)), F.col(lost))), kept, lost


def line_digests(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, kept_sha256.  Null or empty text is one empty line."""

    @F.pandas_udf("long")
    def lost(drops):
        return drops.map(lambda x: 0 if x is None else int((np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)) == 0).sum()))

    narrow = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    out, done, gone = _applied(narrow, min_docs, keep_first, min_chars, id_col, text_col)
    kept = F.coalesce(F.col(done), F.col(text_col))
    count = lambda t: (F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1).cast("long")
    return out.select(id_col, count(F.col(text_col)).alias("n_lines"), lost(F.col(gone)).alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))
