"""Runs that can be taken up again: which documents are done, with the rows that they gave.

A ledger is a folder of commits.  A commit is a folder of its own with the rows that some documents gave (rows) and the ids
and content hashes of those documents (entries), written beside the ledger's commits and moved among them by one
rename.  So a run that is killed leaves whole commits only, and the next run does the documents without an entry and those
whose text has changed.  Of several commits that name a document the last counts, so texts done twice, by a second attempt
or after a change, do not double rows; a document that gives no row has an entry all the same.

    done = resume(docs, work, folder)      # work: DataFrame of documents -> DataFrame with the documents' ids
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "__commit"


class Ledger:
    def __init__(self, spark: SparkSession, path: str, run_id: str = "run"):
        self.spark, self.path = spark, f"{path.rstrip('/')}/{run_id}"
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Names of whole commits, in their order."""
        if not self._fs.exists(self._paths(self.path)):
            return []
        return sorted(n for s in self._fs.listStatus(self._paths(self.path)) if (n := s.getPath().getName()).startswith("commit-"))

    def _read(self, part: str, schema: StructType) -> DataFrame:
        """A part of all commits, each row with its commit's name."""
        folders = [f"{self.path}/{c}/{part}" for c in self.commits()]
        at = F.regexp_extract(F.col("_metadata.file_path"), r"/(commit-[^/]+)/", 1).alias(COMMIT)
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn(COMMIT, F.lit(""))
        return self.spark.read.schema(schema).parquet(*folders).select("*", at)

    def entries(self, key_type: str) -> DataFrame:
        """key, content hash and commit: the last entry of every document."""
        e = self._read("entries", StructType.fromDDL(f"key {key_type}, content long"))
        return e.groupBy("key").agg(F.max(F.struct(COMMIT, "content")).alias("e")).select("key", F.col("e.content").alias("content"), F.col(f"e.{COMMIT}").alias(COMMIT))

    def add(self, entries: DataFrame, rows: DataFrame) -> None:
        """One commit: both tables are written, then appear at once."""
        seq = max((int(c.split("-")[1]) for c in self.commits()), default=-1) + 1
        name = f"{seq:010d}-{uuid.uuid4().hex}"
        staged = f"{self.path}/_staged-{name}"
        rows.write.parquet(f"{staged}/rows")
        entries.write.parquet(f"{staged}/entries")
        if not self._fs.rename(self._paths(staged), self._paths(f"{self.path}/commit-{name}")):
            raise OSError(f"could not commit {staged}")

    def rows(self, schema: StructType, key: str) -> DataFrame:
        """The rows that count: those of each document's last commit."""
        kind = schema[key].dataType.simpleString()
        last = self.entries(kind).select(F.col("key").alias("__key"), F.col(COMMIT).alias("__last"))
        r = self._read("rows", schema)
        return r.join(last, r[key].eqNullSafe(last["__key"]) & (r[COMMIT] == last["__last"]), "left_semi").drop(COMMIT)


def resume(docs: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, run_id: str = "run", key: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """work's rows for all of docs; documents that the ledger at ``path`` has with the same text are not worked again.

    ``work`` keeps the ``key`` column.  Documents are worked in ``batches`` parts by hash of the key, each a commit.  Rows of
    one key are one document: its content is that of all of them.  Documents that are gone from docs give no row.
    """
    spark = docs.sparkSession
    ledger = Ledger(spark, path, run_id)
    kind = docs.schema[key].dataType.simpleString()
    each = F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0")))
    now = docs.groupBy(F.col(key).alias("key")).agg(F.hash(F.sort_array(F.collect_list(each))).cast("long").alias("h"), F.bit_xor(each).alias("x"), F.count("*").alias("n"))
    now = now.select("key", F.xxhash64("h", "x", "n").alias("content"))
    schema = work(docs.limit(0)).schema
    for b in range(batches):
        mine = now.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b)
        done = ledger.entries(kind)
        open_ = mine.join(done, mine["key"].eqNullSafe(done["key"]) & (mine["content"] == done["content"]), "left_anti")
        if open_.isEmpty():
            continue
        todo = docs.join(open_.select(F.col("key").alias("__key")), docs[key].eqNullSafe(F.col("__key")), "left_semi")
        ledger.add(open_, work(todo))
    rows = ledger.rows(schema, key)
    return rows.join(now.select(F.col("key").alias("__key")), rows[key].eqNullSafe(F.col("__key")), "left_semi")
