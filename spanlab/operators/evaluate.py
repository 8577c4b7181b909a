"""Aggregations over match counts and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions import text as T


def per_label(counts: DataFrame, by: list[str] = ["label"]) -> DataFrame:  # noqa: B006
    """tp, fp, fn summed, with precision, recall and f1."""
    return counts.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(*by, "tp", "fp", "fn", *T.prf())


def micro(counts: DataFrame) -> DataFrame:
    return counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn"))).select("tp", "fp", "fn", *T.prf())


def macro(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Unweighted means over the whole vocabulary (column label); labels without counts are 0."""
    p = vocabulary.select("label").distinct().join(per_label(counts), "label", "left").na.fill(0.0, ["precision", "recall", "f1"])
    return p.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def with_micro(counts: DataFrame, name: str = "MICRO") -> DataFrame:
    """Label rows and one row over all of them."""
    r = counts.rollup("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.grouping("label").alias("__all"))
    return r.select(F.when(F.col("__all") == 1, name).otherwise(F.col("label")).alias("label"), "tp", "fp", "fn", *T.prf())


def wide_scores(counts: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """One row per ``by``: overall tp, fp, fn, precision, recall, f1 and a column F1_<label> for each label."""
    per = per_label(counts, [*by, "label"]).groupBy(*by).pivot("label", labels).agg(F.first("f1"))
    per = per.select(*by, *(F.coalesce(F.col(f"`{x}`"), F.lit(0.0)).alias(f"F1_{x}") for x in labels))
    return per_label(counts, by).join(per, by)


def top_k(rows: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value: by, value, n, rank."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def coverage(rows: DataFrame, by: list[str], value: str, k: int = 3) -> DataFrame:
    """Share of the k most frequent values."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    ranked = n.withColumns({"__r": F.row_number().over(w.orderBy(F.desc("n"), value)), "__t": F.sum("n").over(w)})
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col("__r") <= k, F.col("n"))) / F.max("__t")).alias("coverage"))


def mode_of(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least at ties."""
    return top_k(rows, by, value, 1).select(*by, F.col(value).alias("mode"), "n")


def sample_values(rows: DataFrame, by: list[str], value: str, k: int = 20) -> DataFrame:
    """The first k distinct values, joined by |.  Ranks over distinct values, so no group's set is held in memory."""
    w = Window.partitionBy(*by).orderBy(value)
    d = rows.select(*by, value).distinct().withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return d.groupBy(*by).agg(F.concat_ws("|", F.array_sort(F.collect_list(value))).alias("samples"))


def presence(rows: DataFrame, docs: DataFrame, by: list[str] = ["label"], doc: str = "doc_id") -> DataFrame:  # noqa: B006
    """Documents with the label over all documents."""
    total = docs.agg(F.countDistinct(doc).alias("total_docs"))
    return rows.groupBy(*by).agg(F.countDistinct(doc).alias("docs")).crossJoin(F.broadcast(total)).withColumn("presence_ratio", T.ratio("docs", "total_docs"))


def stratification(rows: DataFrame, folds: list[str], label: str = "label", fold: str = "fold", ok: float = 2.0, warn: float = 5.0) -> DataFrame:
    """Per label the percentage in each fold, the largest distance from the fold's own share, and OK, WARN or BAD."""
    n = rows.groupBy(label).agg(*(F.sum((F.col(fold) == f).cast("long")).alias(f) for f in folds))
    total = rows.agg(*(F.sum((F.col(fold) == f).cast("long")).alias(f"__{f}") for f in folds), F.count("*").alias("__n"))
    out = n.crossJoin(F.broadcast(total))
    row = sum((F.col(f"`{f}`") for f in folds[1:]), F.col(f"`{folds[0]}`"))
    share = {f: 100.0 * F.col(f"`{f}`") / row for f in folds}
    far = F.greatest(*(F.abs(share[f] - 100.0 * F.col(f"__{f}") / F.col("__n")) for f in folds), F.lit(0.0))
    return out.select(label, *(share[f].alias(f"pct_{f}") for f in folds), far.alias("diff"), F.when(far < ok, "OK").when(far < warn, "WARN").otherwise("BAD").alias("status"))


def best_by(rows: DataFrame, by: list[str], score: str, order: list[str]) -> DataFrame:
    """The whole row of the greatest score in each group, the first by ``order`` at ties."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), *order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def gap(scores: DataFrame, by: list[str], fold: str = "fold", first: str = "train", second: str = "test", score: str = "f1") -> DataFrame:
    """score of one fold less that of the other."""
    pick = lambda f: F.max(F.when(F.col(fold) == f, F.col(score)))
    return scores.groupBy(*by).agg(pick(first).alias(first), pick(second).alias(second)).withColumn("gap", F.col(first) - F.col(second))


def summary(rows: DataFrame, name: str, score: str) -> DataFrame:
    """Mean, greatest and least score, and the first name that reaches each; n, and how many are above 0.7."""
    at = lambda c: F.struct(c.alias("s"), F.col(name).alias("n"))
    s = F.col(score)
    return rows.agg(F.avg(s).alias("mean"), F.max(s).alias("greatest"), F.min(at(-s)).getField("n").alias("greatest_name"), F.min(s).alias("least"), F.min(at(s)).getField("n").alias("least_name"), F.count(s).alias("n"), F.sum((s > 0.7).cast("long")).alias("n_above"))


def empty_predictions(docs: DataFrame) -> DataFrame:
    """Annotated documents (n_gold, n_pred) without any prediction."""
    return docs.agg(F.sum(F.when((F.col("n_gold") > 0) & (F.col("n_pred") == 0), 1).otherwise(0)).alias("n_empty"), F.count("*").alias("n_docs"))


def compare_table(scores: DataFrame, name: str = "name", value: str = "f1", methods: list[str] | None = None) -> DataFrame:
    """Names <dataset>_<method> as rows of datasets and columns of methods."""
    s = scores.withColumns({"dataset": F.element_at(F.split(name, "_", 2), 1), "method": F.element_at(F.split(name, "_", 2), 2)})
    return s.groupBy("dataset").pivot("method", methods).agg(F.max(value)) if methods else s.groupBy("dataset").pivot("method").agg(F.max(value))


def strip_prefix(scores: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Rows whose name starts with the prefix, without it."""
    return scores.where(F.startswith(name, F.lit(prefix))).withColumn(name, F.substring(name, len(prefix) + 1, 1_000_000))


def sequence_prf(gold_tags: DataFrame, pred_tags: DataFrame, keys: list[str], order: list[str], ignore: str = "-100") -> DataFrame:
    """Span tp, fp, fn per label from tag rows; positions whose gold tag is ``ignore`` count on neither side."""
    from spanlab.operators.match import match_set
    from spanlab.operators.tokens import bio_spans

    both = gold_tags.withColumnRenamed("tag", "__g").join(pred_tags.select(*keys, *order, F.col("tag").alias("__p")), [*keys, *order]).where(F.col("__g") != ignore)
    cut = lambda c: bio_spans(both.withColumn("tag", F.col(c)), keys, order).select(*keys, "label", F.col("first").alias("begin"), F.col("last").alias("end"))
    return match_set(cut("__g"), cut("__p"), [*keys, "label"]).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def grid(spark, **values: list) -> DataFrame:
    """All combinations of parameter lists, a row each; the lists are parameters, so the product is as large as asked for."""
    out = None
    for k, v in values.items():
        one = spark.createDataFrame([(x,) for x in v], [k])
        out = one if out is None else out.crossJoin(one)
    return out


def not_yet(rows: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key has no output yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def percent_text(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def label_vector(rows: DataFrame, labels: list[str], doc: str = "doc_id", label: str = "label") -> DataFrame:
    """One row per document with a 0/1 column for each label."""
    return rows.groupBy(doc).agg(*(F.max((F.col(label) == x).cast("int")).alias(x) for x in labels))


def split_counts(spans: DataFrame, split: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """fold, kind, key, n: per fold of split (doc_id, fold) how often each label occurs, how often negated, and each relation's type.

    spans have doc_id, label and, where it is known, a boolean ``negated``; documents in no fold are left out.
    """
    negated = F.coalesce("negated", F.lit(False)) if "negated" in spans.columns else F.lit(False)
    rows = spans.select("doc_id", F.col("label").alias("key"), negated.alias("negated"), F.lit(False).alias("relation"))
    if relations is not None:
        rows = rows.unionByName(relations.select("doc_id", F.col("type").alias("key"), F.lit(False).alias("negated"), F.lit(True).alias("relation")))
    # the split, a row a document, is what a task holds; spans and relations pass by it unsorted
    held = split.select("doc_id", "fold").repartition("doc_id").distinct().hint("shuffle_hash")
    counts = rows.join(held, "doc_id").groupBy("fold", "key", "negated", "relation").agg(F.count("*").alias("n"))
    kinds = F.when(F.col("relation"), F.array(F.lit("relation"))).when(F.col("negated"), F.array(F.lit("label"), F.lit("negated"))).otherwise(F.array(F.lit("label")))
    return counts.select("fold", F.explode(kinds).alias("kind"), "key", "n").groupBy("fold", "kind", "key").agg(F.sum("n").alias("n"))


def first_rows(rows: DataFrame, by: list[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows in the order ``by``, sorted so, with their ``place`` from 1.  Each task sorts and keeps its first ones."""
    return rows.orderBy(*by).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*by))).orderBy("place")
