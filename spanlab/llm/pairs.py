"""All pairs within keyed groups of any size, without a large group in one task.

Rows of a group of more than CHUNK rows are dealt to chunks by id; each pair of chunks is a block of its own, so a
block holds at most about twice CHUNK rows.  Blocks stream through a task in sorted order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import materialize

CHUNK = 1024


def in_blocks(rows: DataFrame, keys: list[str], id_col: str, find: Callable[[pa.Table, bool], pa.RecordBatch | None], schema: str, chunk: int = CHUNK) -> DataFrame:
    """find(block, cross) over every block; with ``cross`` only pairs of unlike ``__c`` are asked for.

    Every pair of rows of a group meets in exactly one block.  The sizes of crowded groups are written first: the planner
    sees how few they are, and the rows need no shuffle to meet them.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > chunk).withColumn("__q", F.ceil(F.col("__n") / chunk).cast("int"))
    dealt = rows.join(materialize(sizes.select(*keys, "__q")), keys, "left").withColumn("__q", F.coalesce("__q", F.lit(1)))
    dealt = dealt.withColumn("__c", F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.col("__q")).cast("int"))
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__q") - 1))).drop("__q")
    dealt = dealt.withColumns({"__i": F.least("__c", "__o"), "__j": F.greatest("__c", "__o")}).drop("__o")
    by = [*keys, "__i", "__j"]
    dealt = dealt.withColumn("__g", F.xxhash64(*by)).repartition("__g").sortWithinPartitions("__g", *by)
    at = [dealt.columns.index(c) for c in ("__g", *by)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            if t.num_rows > 1:
                out = find(t, t.column("__i")[0].as_py() != t.column("__j")[0].as_py())
                if out is not None and out.num_rows:
                    yield out

        for b in batches:
            if not b.num_rows:
                continue
            new = None
            for k in at:
                col = b.column(k)
                diff = pc.fill_null(pc.not_equal(col[1:], col[:-1]), False)
                new = diff if new is None else pc.or_(new, diff)
            cuts = [0, *(i + 1 for i in pc.indices_nonzero(new).to_pylist()), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                key = tuple(b.column(k)[s].as_py() for k in at)
                if held and key != last:
                    yield from done()
                    held.clear()
                held.append(b.slice(s, e - s))
                last = key
        if held:
            yield from done()

    return dealt.mapInArrow(run, schema)
