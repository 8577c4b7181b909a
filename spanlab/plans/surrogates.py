"""Span-like tables derived from the driver's tables, in Spark and in SQL, so that every operator has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gold(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem")  # noqa: E741
    b = (F.col("l_partkey") % 500).cast("int")
    return l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), b.alias("begin"), (b + F.col("l_quantity").cast("int")).alias("end"))


def pred(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_linenumber % 5 <> 0")  # noqa: E741
    b = (F.col("l_partkey") % 500 + F.col("l_suppkey") % 4).cast("int")
    return l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), b.alias("begin"), (b + F.col("l_quantity").cast("int")).alias("end"))


def flags(spark, d) -> DataFrame:
    """Three detections per line item: rules, TBM, LLM; an order is a document.

    Seventh line items have labels of their own, which the methods detect equally often.
    """
    l = table(spark, d, "lineitem")  # noqa: E741
    seventh = F.col("l_linenumber") == 7
    hit = lambda plain, odd: F.when(seventh, odd % 2 == 1).otherwise(plain).cast("int")
    return l.select(
        F.when(seventh, F.concat("l_returnflag", F.lit("7"))).otherwise(F.col("l_returnflag")).alias("label"), F.col("l_orderkey").alias("doc_id"),
        hit(F.col("l_discount") >= 0.06, F.col("l_partkey")).alias("rules"), hit(F.col("l_tax") >= 0.04, F.col("l_suppkey")).alias("TBM"), hit(F.col("l_quantity") >= 26, F.col("l_quantity")).alias("LLM"),
    )


def scores(spark, d) -> DataFrame:
    """tp, fp, fn per (method, label, doc_id)."""
    f = flags(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("hit")) for m in ("rules", "TBM", "LLM"))))
    r = f.select("label", "doc_id", each.alias("x")).select("label", "doc_id", "x.*")
    return r.groupBy("method", "label", "doc_id").agg(F.sum("hit").alias("tp"), F.lit(0).cast("long").alias("fp"), F.sum(1 - F.col("hit")).alias("fn"))


def mentions(spark, d) -> DataFrame:
    """Tokens with a capital or a digit first, label = language."""
    t = table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"), F.explode(T.tokens("text", lower=False)).alias("value"))
    return t.where(F.col("value").rlike("^[A-Z0-9]"))


def tags(spark, d) -> DataFrame:
    """BIO tags: each user's events in order."""
    e = table(spark, d, "events")
    t = F.col("event_type")
    tag = F.when(t == "signup", "B-X").when(t == "view", "I-X").when(t == "purchase", "I-Y").when(t == "click", "B-Y").otherwise("O")
    return e.select(F.col("user_id").alias("doc_id"), "ts", "event_id", tag.alias("tag"), F.col("value").alias("score"))


GOLD = "gold AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, CAST(l_partkey % 500 AS INT) AS b, CAST(l_partkey % 500 AS INT) + CAST(l_quantity AS INT) AS e FROM lineitem)"
PRED = "pred AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, CAST(l_partkey % 500 + l_suppkey % 4 AS INT) AS b, CAST(l_partkey % 500 + l_suppkey % 4 AS INT) + CAST(l_quantity AS INT) AS e FROM lineitem WHERE l_linenumber % 5 <> 0)"
BAGS = f"""{GOLD}, {PRED}, bags AS (
  SELECT doc_id, label, b, e, SUM(g)::BIGINT AS g, SUM(p)::BIGINT AS p FROM (
    SELECT *, 1 AS g, 0 AS p FROM gold UNION ALL SELECT *, 0, 1 FROM pred) GROUP BY ALL)"""
COUNTS = f"{BAGS}, counts AS (SELECT doc_id, label, SUM(LEAST(g, p))::BIGINT AS tp, SUM(GREATEST(p - g, 0))::BIGINT AS fp, SUM(GREATEST(g - p, 0))::BIGINT AS fn FROM bags GROUP BY ALL)"
PRF = """CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / (tp + fn)) / ((tp::DOUBLE / (tp + fp)) + (tp::DOUBLE / (tp + fn))) ELSE 0.0 END AS f1"""
FLAGS = """flags AS (SELECT CASE WHEN l_linenumber = 7 THEN l_returnflag || '7' ELSE l_returnflag END AS label, l_orderkey AS doc_id, (CASE WHEN l_linenumber = 7 THEN l_partkey % 2 = 1 ELSE l_discount >= 0.06 END)::INT AS rules,
  (CASE WHEN l_linenumber = 7 THEN l_suppkey % 2 = 1 ELSE l_tax >= 0.04 END)::INT AS tbm, (CASE WHEN l_linenumber = 7 THEN l_quantity % 2 = 1 ELSE l_quantity >= 26 END)::INT AS llm FROM lineitem)"""
MATRIX = f"""{FLAGS}, matrix AS (SELECT label, doc_id,
  2.0::DOUBLE * SUM(rules) / (2 * SUM(rules) + SUM(1 - rules)) AS f1_rules, 2.0::DOUBLE * SUM(tbm) / (2 * SUM(tbm) + SUM(1 - tbm)) AS f1_tbm,
  2.0::DOUBLE * SUM(llm) / (2 * SUM(llm) + SUM(1 - llm)) AS f1_llm FROM flags GROUP BY ALL)"""
MENTIONS = "mentions AS (SELECT doc_id, lang AS label, value FROM (SELECT doc_id, lang, UNNEST(string_split_regex(text, '[^a-zA-Z0-9%]+')) AS value FROM documents) WHERE regexp_matches(value, '^[A-Z0-9]'))"
TAGS = """tags AS (SELECT user_id AS doc_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'B-X' WHEN 'view' THEN 'I-X' WHEN 'purchase' THEN 'I-Y' WHEN 'click' THEN 'B-Y' ELSE 'O' END AS tag, value AS score FROM events),
numbered AS (SELECT *, left(tag, 1) AS k, substr(tag, 3) AS l, ROW_NUMBER() OVER w AS n, LAG(left(tag, 1)) OVER w AS pk, LAG(substr(tag, 3)) OVER w AS pl FROM tags WINDOW w AS (PARTITION BY doc_id ORDER BY ts, event_id)),
started AS (SELECT *, SUM(CASE WHEN k = 'B' OR (k = 'I' AND NOT COALESCE(pk <> 'O' AND pl = l, FALSE)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM numbered),
bio AS (SELECT doc_id, l AS label, (MIN(n) - 1)::INT AS first, (MAX(n) - 1)::INT AS last, COUNT(*) AS n FROM started WHERE k <> 'O' GROUP BY doc_id, s, l)"""
