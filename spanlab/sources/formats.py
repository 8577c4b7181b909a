"""CoNLL, JSON samples, caches and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.model import SAMPLE
from spanlab.sources.brat import read_texts


def parse_conll(texts: DataFrame, min_fields: int = 1) -> DataFrame:
    """Documents (doc_id, text) of ``token ... tag`` lines -> doc_id, sent_id, tok_id, token, tag.  Blank lines end sentences.

    A file is one row, so sentence numbers come from a running count inside that row's lines.
    """
    from pyspark.sql import Window

    l = texts.select("doc_id", F.posexplode(F.split("text", "\r?\n", -1)).alias("no", "line"))  # noqa: E741
    w = Window.partitionBy("doc_id").orderBy("no")
    l = l.withColumn("__f", F.filter(F.split(F.trim("line"), r"\s+"), lambda x: x != ""))  # noqa: E741
    l = l.withColumn("__s", F.sum((F.size("__f") == 0).cast("int")).over(w)).where(F.size("__f") >= max(min_fields, 1))  # noqa: E741
    s = Window.partitionBy("doc_id").orderBy("__s")
    t = Window.partitionBy("doc_id", "__s").orderBy("no")
    return l.select("doc_id", (F.dense_rank().over(s) - 1).alias("sent_id"), (F.row_number().over(t) - 1).alias("tok_id"), F.element_at("__f", 1).alias("token"), F.element_at("__f", -1).alias("tag"))


def read_conll(spark: SparkSession, path: str, suffix: str = "conll", min_fields: int = 1) -> DataFrame:
    return parse_conll(read_texts(spark, path, suffix, keep_crlf=True), min_fields)


def read_samples(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON samples; ner items [first, last, label] (all strings in the file's mixed arrays) become structs ``spans``."""
    s = spark.read.schema(SAMPLE).option("multiLine", multi_line).json(path)
    return s.withColumn("spans", F.transform("ner", lambda x: F.struct(F.try_element_at(x, F.lit(1)).cast("int").alias("first"), F.try_element_at(x, F.lit(2)).cast("int").alias("last"), F.try_element_at(x, F.lit(3)).alias("label"))))


def read_prediction_cache(spark: SparkSession, path: str) -> DataFrame:
    """{doc: [[begin, end, label], ...]} -> doc_id, begin, end, label."""
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<array<string>>>").alias("m"))
    e = m.select(F.explode("m").alias("doc_id", "s")).select("doc_id", F.explode("s").alias("x"))
    return e.select("doc_id", F.try_element_at("x", F.lit(1)).cast("int").alias("begin"), F.try_element_at("x", F.lit(2)).cast("int").alias("end"), F.try_element_at("x", F.lit(3)).alias("label"))


def read_score_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """{doc: {label: {TP, FP, FN}}} -> doc_id, label, tp, fp, fn.  lines: an object a line, as sinks.score_cache makes them."""
    m = spark.read.text(path, wholetext=not lines).select(F.from_json("value", "map<string,map<string,struct<TP:bigint,FP:bigint,FN:bigint>>>").alias("m"))
    e = m.select(F.explode("m").alias("doc_id", "s")).select("doc_id", F.explode("s").alias("label", "c"))
    return e.select("doc_id", "label", F.col("c.TP").alias("tp"), F.col("c.FP").alias("fp"), F.col("c.FN").alias("fn"))


def optional(read, spark: SparkSession, path: str) -> DataFrame | None:
    """read(spark, path), or None where the path does not exist, in any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return read(spark, path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def read_ids(spark: SparkSession, path: str, fold: str) -> DataFrame:
    """One id a line -> doc_id, fold; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("doc_id"), F.lit(fold).alias("fold")).where("doc_id <> ''")


def frozen_or(split_paths: dict[str, str], spark: SparkSession, make) -> DataFrame:
    """The frozen split where all its files exist, else make()."""
    parts = [optional(lambda s, p, f=f: read_ids(s, p, f), spark, p) for f, p in split_paths.items()]
    if parts and all(p is not None for p in parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    return make()
