"""Writers: stand-off files, CoNLL, JSON, CSV, partitioned splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def brat_text(spans: DataFrame, values: bool = False, tabs: bool = False, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, content: T lines by (begin, end, label), numbered from 1; line breaks in a span's text become spaces.

    values: each span with a ``value`` also gets an A line, white space in it as _, and there is no newline at the end.
    tabs: tabs become spaces too.  documents (doc_id): those without a span have an empty content.
    """
    w = Window.partitionBy("doc_id").orderBy("begin", "end", "label", "text", *(["value"] if values else []))
    clean = F.translate(F.col("text"), "\n\r\t" if tabs else "\n\r", "   " if tabs else "  ")
    s = spans.withColumn("__n", F.row_number().over(w))
    line = F.format_string("T%d\t%s %d %d\t%s", "__n", "label", "begin", "end", clean)
    if values:
        extra = F.when(F.col("value").isNotNull(), F.concat(F.lit("\n"), F.format_string("A%d\tValue T%d %s", "__n", "__n", F.regexp_replace("value", r"\s+", "_"))))
        line = F.concat(line, F.coalesce(extra, F.lit("")))
    body = s.select("doc_id", "__n", line.alias("__l")).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__n", "__l"))), lambda x: x["__l"]), "\n").alias("content"))
    if not values:
        body = body.withColumn("content", F.concat("content", F.lit("\n")))
    if documents is None:
        return body
    return documents.select("doc_id").distinct().join(body, "doc_id", "left").withColumn("content", F.coalesce("content", F.lit("")))


def write_documents(content: DataFrame, path: str, suffix: str = "ann") -> None:
    """One file a row (doc_id, content), as it is, in the folder or URI ``path``: see sources.standoff.

    Files of the same names are replaced; null content is an empty file; a null id, or two rows of one id, is an error,
    after which the folder is as before.
    """
    from spanlab.sources import standoff

    rows = content.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("content").cast("string").alias("content"))
    standoff.write_files(rows, path, suffix)


def conll_text(tokens: DataFrame) -> DataFrame:
    """doc_id, content from doc_id, sent_id, tok_id, token, tag: a blank line after every sentence."""
    sent = tokens.groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", F.concat_ws(" ", "token", "tag").alias("l")))).alias("a"))
    sent = sent.select("doc_id", "sent_id", F.array_join(F.transform("a", lambda x: x["l"]), "\n").alias("s"))
    return sent.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sent_id", "s"))), lambda x: x["s"]), "\n\n"), F.lit("\n\n")).alias("content"))


def sample_json(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, json: tokenized_text and ner [first, last, label] of every document, for training tools."""
    t = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "token"))).getField("token").alias("tokenized_text"))
    n = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last", "label"))).alias("ner"))
    return json_of_samples(t.join(n, "doc_id", "left"))


def json_of_samples(samples: DataFrame) -> DataFrame:
    """sample_json of documents that are whole: doc_id, tokenized_text and sorted ner (first, last, label), null for none (see tokens.rule_samples)."""
    ner = F.transform("ner", lambda x: F.array(x["first"].cast("string"), x["last"].cast("string"), x["label"]))
    j = samples.withColumn("ner", F.coalesce(ner, F.array().cast("array<array<string>>")))
    return j.select("doc_id", F.to_json(F.struct("tokenized_text", "ner", F.col("doc_id").cast("string").alias("_source"))).alias("json"))


def bio_json(tokens: DataFrame) -> DataFrame:
    """doc_id, json from doc_id, tok_id, token, tag: {"id", "tokens", "ner_tags"} of every document, in token order."""
    t = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("tok_id", "token", "tag"))).alias("t"))
    body = F.struct(F.col("doc_id").cast("string").alias("id"), F.transform("t", lambda x: x["token"]).alias("tokens"), F.transform("t", lambda x: x["tag"]).alias("ner_tags"))
    return t.select("doc_id", F.to_json(body).alias("json"))


def score_cache(scores: DataFrame) -> DataFrame:
    """doc_id, json from doc_id, label, tp, fp, fn: {doc: {label: {"TP", "FP", "FN"}}} of one document, which formats.read_score_cache reads as lines; repeated labels are summed."""
    one = scores.groupBy("doc_id", "label").agg(F.sum("tp").alias("TP"), F.sum("fp").alias("FP"), F.sum("fn").alias("FN"))
    entries = F.sort_array(F.collect_list(F.struct("label", F.struct("TP", "FP", "FN"))))
    return one.groupBy("doc_id").agg(F.map_from_entries(entries).alias("m")).select("doc_id", F.to_json(F.create_map(F.col("doc_id").cast("string"), "m")).alias("json"))


def report(decisions: DataFrame, name: str = "run") -> DataFrame:
    """One row (name, json): how many labels, how many of each decision, and each label's row, from a table with label and method."""
    counts = F.transform(F.array_sort(F.array_distinct(F.collect_list(F.coalesce("method", F.lit("excluded"))))), lambda m: m)
    rows = F.sort_array(F.collect_list(F.struct("label", *(c for c in decisions.columns if c != "label"))))
    g = decisions.agg(F.count("*").alias("n_labels"), counts.alias("methods"), rows.alias("labels"))
    return g.select(F.lit(name).alias("name"), F.to_json(F.struct("n_labels", "methods", "labels")).alias("json"))


def prediction_cache(spans: DataFrame) -> DataFrame:
    """doc_id, json: a document's sorted [begin, end, label] spans."""
    return spans.groupBy("doc_id").agg(F.to_json(F.transform(F.sort_array(F.collect_set(F.struct("begin", "end", "label"))), lambda x: F.array(x["begin"].cast("string"), x["end"].cast("string"), x["label"]))).alias("json"))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", run_id: str | None = None, mode: str = "overwrite", one_file: bool = False) -> None:
    """Parquet, CSV with header, or JSON; run_id adds a partition column and appends, so earlier runs stay."""
    if run_id is not None:
        df, mode = df.withColumn("run_id", F.lit(run_id)), "append"
    w = (df.coalesce(1) if one_file else df).write.mode(mode)
    if run_id is not None:
        w = w.partitionBy("run_id")
    {"parquet": w.parquet, "csv": w.option("header", True).csv, "json": w.json}[fmt](path)


def write_split(docs: DataFrame, split: DataFrame, path: str) -> None:
    """Documents in one directory a fold."""
    docs.join(split, "doc_id").write.mode("overwrite").partitionBy("fold").parquet(path)


def report_html(title: str, df: DataFrame, limit: int = 500) -> str:
    """A table of a summary's first ``limit`` rows; summaries have a row per label."""
    from html import escape

    rows = df.limit(limit).collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"
