"""Helpers shared by the corpus operators: materialisation, row keys, connected components."""

from __future__ import annotations

import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line contracts.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor shares: spark.checkpoint.dir, or one that SparkContext.setCheckpointDir was given.

    A local master may do without: it gets a folder in the warehouse.  On a cluster a missing setting is an error, as
    other machines would not see a local folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/spanlab-checkpoint"
    if named and sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named or sc._jsc.sc().getCheckpointDir().get()


def working_names(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out


#: Spark's setting by which a statement's shuffle files go when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """This application's tables; they are deleted when its driver ends, if not before."""
    folder = f"{shared_dir(spark).rstrip('/')}/spanlab/{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


#: The driver collects its heap for _tidy at most this part of the time.
TIDY_SHARE = 0.02
_tidied = [0.0, 0.0]  # when, and how long it took


def _tidy(spark: SparkSession) -> None:
    """Let go of what finished statements have broadcast: executors hold it, a page of memory for each join, until the driver collects.

    Spark does so every half an hour by itself.  The next time comes when the last one's length is TIDY_SHARE of the time since,
    so a large driver, whose collections take long, does it seldom.
    """
    now = time.monotonic()
    if now - _tidied[0] >= _tidied[1] / TIDY_SHARE:
        spark.sparkContext._jvm.System.gc()
        _tidied[:] = [time.monotonic(), time.monotonic() - now]


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files outlive lost executors, and the planner sees their true size.  What was shuffled to make them is let go at
    once.  They stay, under <shared>/spanlab/<application id>/, until discard, the end of a scratch() that they were
    written in, or the end of the application.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    if _scopes:
        _scopes[-1].append(path)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are written inside are deleted at the end, but those whose frames are given to the function that it yields."""
    paths: list[str] = []
    _scopes.append(paths)
    kept: set[str] = set()
    try:
        yield lambda df: kept.update(f.rsplit("/", 2)[1] for f in df.inputFiles())
    finally:
        _scopes.remove(paths)
        for p in paths:
            if p.rsplit("/", 1)[1] not in kept:
                _delete(spark, p)
        if _scopes:
            _scopes[-1].extend(p for p in paths if p.rsplit("/", 1)[1] in kept)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(written: DataFrame) -> None:
    """Delete the files of a table that materialize wrote and nothing reads any more."""
    spark = written.sparkSession
    folder = _folder(spark)
    for parent in {f.rsplit("/", 1)[0] for f in written.inputFiles()}:
        _delete(spark, f"{folder}/{parent.rsplit('/', 1)[1]}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component): the smallest node that u reaches, for every node of an edge.

    Alternating large-star and small-star rounds: each round is two aggregations and two joins on node ids, and no
    node's neighbours ever meet in one task.  Rounds are cut with written tables; they grow with the logarithm of
    the longest shortest path.  Nulls and loops are ignored.
    """
    pairs = materialize(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(pairs)
    while seen[0]:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        before, pairs = pairs, materialize(small)
        discard(before)
        now = mark(pairs)
        if now == seen:
            break
        seen = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
