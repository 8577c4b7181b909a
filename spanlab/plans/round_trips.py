"""Queries that write files in a shared folder and read them again, and queries over extraction, tags and models, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import evaluate as E
from spanlab.operators import spans as P
from spanlab.operators import splits as X
from spanlab.operators import tokens as K
from spanlab.plans import surrogates as U
from spanlab.plans.catalog import _ann, _docs
from spanlab.plans.registry import query
from spanlab.plans.surrogates import GOLD, TAGS
from spanlab.sources import brat, formats, predict, shared, sinks

# --- stand-off files ----------------------------------------------------------------------------------------------


@query("SELECT f AS label, COUNT(*) AS spans, SUM(n)::BIGINT AS n, MAX(n) AS most FROM (SELECT l_orderkey, l_returnflag AS f, l_partkey % 500 AS b, l_partkey % 500 + 9 + l_quantity::BIGINT AS e, COUNT(*) AS n FROM lineitem GROUP BY ALL) GROUP BY f")
def brat_bag(spark, d):
    """Spans as a bag: repeated ones with their counts."""
    b = brat.span_bag(brat.parse_spans(_ann(spark, d)))
    return b.groupBy("label").agg(F.count("*").alias("spans"), F.sum("n").alias("n"), F.max("n").alias("most"))


@query("SELECT l_returnflag AS label, COUNT(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def brat_label_filter(spark, d):
    return brat.parse_spans(_ann(spark, d), labels=["A", "R"]).groupBy("label").agg(F.count("*").alias("n"))


def _files(spark, d, folder: str) -> DataFrame:
    """Documents as files in one folder a language, with hidden and backup files beside them."""
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.concat(F.lit("T1\tX 0 1\t"), F.substring("source", 1, 1)).alias("content"))
    langs = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]
    for lang in langs:
        sinks.write_documents(docs.where(F.col("lang") == lang), f"{folder}/{lang}")
    sinks.write_documents(docs.where("doc_id < '2'"), f"{folder}/{langs[0]}", "bak")
    return docs


@query("SELECT lang AS dir, COUNT(*) AS n, SUM(doc_id)::BIGINT AS ids, COUNT(*) AS paths FROM documents GROUP BY lang")
def file_listing(spark, d):
    """Stems and paths of files in sub-folders, other suffixes left out."""
    folder = shared.scratch_folder(spark, "listing")
    _files(spark, d, folder)
    stems = brat.list_documents(spark, folder, recursive=True)
    paths = brat.list_documents(spark, folder, recursive=True, by="path").select("path").distinct()
    dir_of = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("dir")
    n = stems.groupBy(dir_of).agg(F.count("*").alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids"))
    return n.join(paths.groupBy(dir_of).agg(F.count("*").alias("paths")), "dir")


@query("SELECT COUNT(*) AS files, COUNT(*) AS spans, (SELECT COUNT(*) FROM documents WHERE lang = (SELECT MIN(lang) FROM documents)) AS flat FROM documents")
def file_reading(spark, d):
    """Spans of all sub-folders' files, and the files of one folder read flat."""
    folder = shared.scratch_folder(spark, "reading")
    docs = _files(spark, d, folder)
    lines = brat.read_lines(spark, folder, recursive=True)
    first = docs.agg(F.min("lang")).first()[0]
    flat = brat.read_texts(spark, f"{folder}/{first}", "ann").agg(F.count("*").alias("flat"))
    return lines.agg(F.countDistinct("doc_id").alias("files")).join(brat.parse_spans(lines).agg(F.count("*").alias("spans"))).join(flat)


def _writer_sql(text: str, value: str, end: str) -> str:
    return f"""WITH g AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, l_partkey % 500 AS b, l_partkey % 500 + l_quantity::BIGINT AS e, {text} AS t, {value} AS v FROM lineitem),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY b, e, label, t, v NULLS FIRST) AS i FROM g), c AS (SELECT doc_id, string_agg('T' || i || chr(9) || label || ' ' || b || ' ' || e || chr(9) || translate(t, chr(9), ' ') || coalesce(chr(10) || 'A' || i || chr(9) || 'Value T' || i || ' ' || replace(v, ' ', '_'), ''), chr(10) ORDER BY i) || {end} AS c FROM n GROUP BY doc_id)
SELECT doc_id, length(c) AS n_chars, sha256(c) AS sha256 FROM c"""


def _with_text(spark, d, text) -> DataFrame:
    b = F.col("l_partkey") % 500
    return U.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), b.alias("begin"), (b + F.col("l_quantity").cast("long")).alias("end"), text.alias("text"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("size "), F.col("l_quantity").cast("int").cast("string"))).alias("value"))


@query(_writer_sql("l_partkey::VARCHAR", "CASE WHEN l_linenumber % 2 = 0 THEN 'size ' || l_quantity::INT END", "''"))
def brat_value_writer(spark, d):
    """Spans with their values as attributes; no newline at the end."""
    s = _with_text(spark, d, F.col("l_partkey").cast("string"))
    return sinks.brat_text(s, values=True).select("doc_id", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query(_writer_sql("l_partkey || chr(9) || l_suppkey", "NULL", "chr(10)"))
def brat_tab_writer(spark, d):
    """A model's spans, whose tabs become spaces."""
    s = _with_text(spark, d, F.concat_ws("\t", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")))
    return sinks.brat_text(s, tabs=True).select("doc_id", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


# --- other files --------------------------------------------------------------------------------------------------


@query(f"""WITH {TAGS}, t AS (SELECT doc_id, COUNT(*) AS n_tokens FROM tags GROUP BY doc_id) SELECT doc_id, n_tokens, COUNT(b.label) AS n_spans, coalesce(SUM(first), 0)::BIGINT AS firsts, coalesce(SUM(last), 0)::BIGINT AS lasts, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM t LEFT JOIN bio b USING (doc_id) GROUP BY doc_id, n_tokens""")
def ner_samples(spark, d):
    """Tagged events as training samples in JSON files, read again."""
    t = U.tags(spark, d).drop("score")
    spans = K.bio_spans(t, order=["ts", "event_id"])
    tok = t.select("doc_id", F.struct("ts", "event_id").alias("tok_id"), F.format_string("e%d", "event_id").alias("token"))
    folder = f"{shared.scratch_folder(spark, 'samples')}/s"
    sinks.sample_json(tok, spans).select(F.col("json").alias("value")).write.text(folder)
    s = formats.read_samples(spark, folder, multi_line=False)
    at = lambda c: F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x[c]), F.lit(0).cast("long"))
    labels = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["label"]))), ",")
    return s.select(F.col("_source").cast("long").alias("doc_id"), F.size("tokenized_text").cast("long").alias("n_tokens"), F.size("spans").cast("long").alias("n_spans"), at("first").alias("firsts"), at("last").alias("lasts"), F.when(labels != "", labels).alias("labels"))


@query(f"""WITH {GOLD} SELECT doc_id::VARCHAR AS doc_id, COUNT(DISTINCT (b, e, label)) AS n, SUM(DISTINCT b)::BIGINT AS begins FROM gold GROUP BY doc_id""")
def prediction_cache(spark, d):
    """Spans of documents as cache lines in files, read again."""
    folder = f"{shared.scratch_folder(spark, 'cache')}/c"
    c = sinks.prediction_cache(U.gold(spark, d))
    c.select(F.to_json(F.create_map(F.col("doc_id").cast("string"), F.from_json("json", "array<array<string>>"))).alias("value")).write.text(folder)
    lines = spark.read.text(folder).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("doc_id", "s"))
    # a document is one line, so its spans are counted where they are read
    begins = F.array_compact(F.array_distinct(F.transform("s", lambda x: F.element_at(x, 1).cast("long"))))
    total = F.aggregate(begins, F.lit(0).cast("long"), lambda a, x: a + x)
    return lines.select("doc_id", F.size("s").cast("long").alias("n"), F.when(F.size(begins) > 0, total).alias("begins"))


@query("SELECT s_nationkey::VARCHAR AS doc_id, COUNT(*) AS labels, SUM(s_suppkey % 7)::BIGINT AS tp, SUM(s_suppkey % 3)::BIGINT AS fn FROM supplier GROUP BY ALL")
def score_cache_files(spark, d):
    """Scores as cache lines in files; an absent cache is none."""
    s = U.table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("label"), (F.col("s_suppkey") % 7).alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("s_suppkey") % 3).alias("fn"))
    folder = shared.scratch_folder(spark, "scores")
    sinks.score_cache(s).select(F.col("json").alias("value")).write.text(f"{folder}/c")
    read = lambda spark, path: formats.read_score_cache(spark, path, lines=True)
    if formats.optional(read, spark, f"{folder}/none") is not None:
        raise AssertionError("a cache that nobody wrote")
    return formats.optional(read, spark, f"{folder}/c").groupBy("doc_id").agg(F.count("*").alias("labels"), F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))


@query("SELECT CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END AS fold, COUNT(*) AS n, SUM(doc_id)::BIGINT AS ids, (SELECT COUNT(*) FROM documents) AS made FROM documents GROUP BY ALL")
def frozen_split(spark, d):
    """A split kept as files of ids is read; where one of its files lacks, a new one is made."""
    ids = _docs(spark, d).select(F.col("doc_id").cast("string").alias("value"))
    folder = shared.scratch_folder(spark, "split")
    parts = {"train": ids.where("value % 4 <> 0"), "test": ids.where("value % 4 = 0")}
    for fold, part in parts.items():
        part.write.text(f"{folder}/{fold}")
    at = {fold: f"{folder}/{fold}" for fold in parts}
    other = lambda: ids.select(F.col("value").alias("doc_id"), F.lit("new").alias("fold"))
    made = formats.frozen_or(at | {"dev": f"{folder}/dev"}, spark, other).agg(F.count("*").alias("made"))
    return formats.frozen_or(at, spark, other).groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.col("doc_id").cast("long")).alias("ids")).join(made)


@query("SELECT o_orderpriority AS p, o_clerk AS c, COUNT(*) AS n FROM (SELECT o_orderpriority, o_orderstatus || ', \"x\"' AS o_clerk FROM orders UNION ALL SELECT o_orderpriority, o_orderstatus || ', \"x\"' FROM orders WHERE o_orderkey % 3 = 0) GROUP BY ALL")
def csv_table(spark, d):
    """A table as CSV with commas and quotes in its fields, appended to with its header, read again."""
    t = U.table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.concat("o_orderstatus", F.lit(', "x"')).alias("c"))
    folder = f"{shared.scratch_folder(spark, 'csv')}/t"
    sinks.write_table(t.drop("o_orderkey"), folder, "csv")
    sinks.write_table(t.where("o_orderkey % 3 = 0").drop("o_orderkey"), folder, "csv", mode="append")
    return spark.read.option("header", True).option("escape", "\\").csv(folder).groupBy("p", "c").agg(F.count("*").alias("n"))


@query("SELECT 'run-' || (o_orderkey % 3) AS run_id, COUNT(*) AS n, SUM(o_custkey)::BIGINT AS c FROM orders GROUP BY ALL")
def numbered_runs(spark, d):
    """Rows of runs, each appended under its number; earlier runs stay."""
    t = U.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    folder = f"{shared.scratch_folder(spark, 'runs')}/t"
    for k in range(3):
        sinks.write_table(t.where(F.col("o_orderkey") % 3 == k), folder, run_id=f"run-{k}")
    return spark.read.parquet(folder).groupBy("run_id").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("c"))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS fold, COUNT(*) AS n, SUM(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def split_files(spark, d):
    """Documents in one folder a fold, read again."""
    docs = _docs(spark, d)
    r = F.col("doc_id") % 10
    folder = f"{shared.scratch_folder(spark, 'folds')}/t"
    sinks.write_split(docs, docs.select("doc_id", F.when(r == 0, "test").when(r == 1, "dev").otherwise("train").alias("fold")), folder)
    return spark.read.parquet(folder).groupBy("fold").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT p_type AS label, CASE WHEN MAX(p_size) >= 50 THEN 'LLM' WHEN MIN(p_size) <= 1 THEN 'rules' END AS method, COUNT(*) AS n, (SELECT COUNT(DISTINCT p_type) FROM part) AS n_labels FROM part GROUP BY p_type")
def json_report(spark, d):
    """Decisions by label as one JSON report, read again."""
    n = U.table(spark, d, "part").groupBy(F.col("p_type").alias("label")).agg(F.when(F.max("p_size") >= 50, "LLM").when(F.min("p_size") <= 1, "rules").alias("method"), F.count("*").alias("n"))
    j = F.from_json("json", "n_labels bigint, methods array<string>, labels array<struct<label:string,method:string,n:bigint>>")
    return sinks.report(n).select(j.alias("j")).select("j.n_labels", F.explode("j.labels").alias("x")).select("x.label", "x.method", "x.n", "n_labels")


# --- extraction, tags, models -------------------------------------------------------------------------------------

ASCII_RULES = [(r"[0-9]+", "NUMBER", 2, ""), (r"[A-Z][a-z]{3,}", "NAME", 1, ""), (r"[a-z]+ed", "PAST", 3, "")]


@query(" UNION ALL ".join(f"SELECT '{label}' AS label, {p} AS priority, SUM(len(m))::BIGINT AS n, SUM(list_sum(list_transform(m, lambda x: length(x))))::BIGINT AS chars, MAX(list_max(m)) AS last FROM (SELECT regexp_extract_all(text, '{rx}') AS m FROM documents WHERE text IS NOT NULL)" for rx, label, p, _ in ASCII_RULES))
def extract_rules(spark, d):
    """Every match of three rules: how many, how long, and the last by text; offsets give back the text."""
    docs = _docs(spark, d).select("doc_id", "text")
    s = P.extract_spans(docs, ASCII_RULES)
    held = s.join(docs.withColumnRenamed("text", "t"), "doc_id").where(F.expr("substring(t, begin + 1, end - begin) = text"))
    return held.groupBy("label", "priority").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("begin")).alias("chars"), F.max("text").alias("last"))


@query("""SELECT p_partkey AS doc_id, 'HER2' AS label, 'HER2 pos ' || p_size AS text FROM part WHERE p_partkey % 4 = 0""")
def extract_findings(spark, d):
    """Findings by verbose patterns; bare marker names, conditions and antibodies are none."""
    p = U.table(spark, d, "part")
    k = F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit("HER2 pos "), F.col("p_size").cast("string"))).when(k == 1, "HER2").when(k == 2, "si HER2 pos 3").otherwise("anti HER2 pos")
    rule = (r"(?:si[ ]|anti[ ])?  HER2  (?:[ ]pos(?:[ ][0-9]+)?)?  # a marker with its status", "HER2", 1)
    f = P.extract_findings(p.select(F.col("p_partkey").alias("doc_id"), said.alias("text")), [rule])
    return f.select("doc_id", "label", "text")


@query("""WITH e AS (SELECT user_id AS doc_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, COUNT(*) OVER (PARTITION BY user_id) AS n, event_type FROM events),
s AS (SELECT doc_id, i AS first, i + event_id % 4 AS last, event_type AS label, i AS ord FROM e WHERE i % 3 = 0), c AS (SELECT doc_id, UNNEST(range(first, last + 1)) AS i, first, label, ord FROM s JOIN (SELECT DISTINCT doc_id, n FROM e) USING (doc_id) WHERE last < n),
b AS (SELECT doc_id, i, arg_max(CASE WHEN i = first THEN 'B-' ELSE 'I-' END || label, ord) AS tag FROM c GROUP BY ALL) SELECT coalesce(tag, 'O') AS tag, COUNT(*) AS n, SUM(e.i)::BIGINT AS places FROM e LEFT JOIN b USING (doc_id, i) GROUP BY ALL""")
def bio_tags(spark, d):
    """Token spans as tags: later ones overwrite earlier ones, ones out of range are ignored."""
    from pyspark.sql import Window

    e = U.table(spark, d, "events")
    i = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    t = e.select(F.col("user_id").alias("doc_id"), "event_id", "event_type", i.alias("tok_id"))
    s = t.where("tok_id % 3 = 0").select("doc_id", F.col("tok_id").alias("first"), (F.col("tok_id") + F.col("event_id") % 4).alias("last"), F.col("event_type").alias("label"), F.col("tok_id").alias("ord"))
    return K.bio_tags(t.select("doc_id", "tok_id"), s).groupBy("tag").agg(F.count("*").alias("n"), F.sum("tok_id").alias("places"))


@query("""WITH x AS (SELECT doc_id, list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda w: w <> '') AS a FROM documents), t AS (SELECT doc_id, UNNEST(a) AS token, generate_subscripts(a, 1) - 1 AS i FROM x),
o AS (SELECT doc_id, i, SUM(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e, length(token) AS n FROM t) SELECT a.doc_id, COUNT(*) AS n, SUM(a.e - a.n)::BIGINT AS begins, SUM(b.e)::BIGINT AS ends FROM o a JOIN o b ON b.doc_id = a.doc_id AND b.i = a.i + 2 WHERE a.i % 5 = 0 GROUP BY a.doc_id""")
def char_spans(spark, d):
    """Token spans as characters."""
    t = K.offsets_of(_docs(spark, d).select("doc_id", F.posexplode(T.tokens("text", lower=False)).alias("tok_id", "token")))
    s = t.where("tok_id % 5 = 0").select("doc_id", F.col("tok_id").alias("first"), (F.col("tok_id") + 2).alias("last"))
    return K.to_char_span(s, t).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("begin").alias("begins"), F.sum("end").alias("ends"))


@query(f"""WITH {TAGS}, g AS (SELECT n.*, event_id * 2 AS b, event_id * 2 + CASE WHEN event_id % 3 = 0 THEN 1000000 ELSE 0 END AS e FROM numbered n), q AS (SELECT *, LAG(e) OVER (PARTITION BY doc_id ORDER BY n) AS pe FROM g),
h AS (SELECT *, SUM(CASE WHEN k = 'B' OR (k = 'I' AND NOT COALESCE(pk <> 'O' AND pl = l AND b <= pe, FALSE)) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s2 FROM q),
z AS (SELECT l AS label, COUNT(*) AS n, MIN(b) AS b, MAX(e) AS e FROM h WHERE k <> 'O' GROUP BY doc_id, s2, l HAVING AVG(score) >= 20)
SELECT label, COUNT(*) AS spans, SUM(n)::BIGINT AS tokens, SUM(b)::BIGINT AS b, SUM(e)::BIGINT AS e FROM z GROUP BY label""")
def gap_spans(spark, d):
    """Tags as spans that a gap between tokens ends too; spans of a low mean score are left out."""
    end = F.col("event_id") * 2 + F.when(F.col("event_id") % 3 == 0, 1_000_000).otherwise(0)
    t = U.tags(spark, d).withColumns({"begin": F.col("event_id") * 2, "end": end})
    s = K.bio_spans(t, order=["ts", "event_id"], gap=True, min_score=20.0)
    return s.groupBy("label").agg(F.count("*").alias("spans"), F.sum("n").alias("tokens"), F.sum("begin").alias("b"), F.sum("end").alias("e"))


def _find_the():
    """A stub of a model: 'the' with a score by its place."""

    def model(texts):
        import re

        return [[(m.start(), m.end(), "THE", (m.start() % 10) / 10) for m in re.finditer("the", t)] for t in texts]

    return model


@query("""SELECT doc_id, len(string_split(text, 'the')) - 1 AS n FROM documents WHERE contains(text, 'the')""")
def predicted_spans(spark, d):
    """Spans from a stub of a model, loaded once a task."""
    s = predict.predict_spans(_docs(spark, d), _find_the)
    return s.where("label = 'THE' and end - begin = 3").groupBy("doc_id").agg(F.count("*").alias("n"))


def _forgetful():
    """A stub of a remote model that fails at every first try of a text."""
    asked = set()

    def ask(prompt: str) -> str:
        if prompt not in asked:
            asked.add(prompt)
            raise ConnectionError("try again")
        return f'Sure: [{{"text": "{prompt}", "label": "X"}}, {{"text": "{prompt}", "label": "other"}}]'

    return ask


@query("SELECT source || '-' || lang AS entity, 'X' AS label, COUNT(*) AS n FROM documents GROUP BY ALL")
def queried_entities(spark, d):
    """Entities from a stub of a remote model that answers at the second try; labels that nobody asked for are left out."""
    q = _docs(spark, d).select("doc_id", F.concat_ws("-", "source", "lang").alias("text"))
    r = predict.query_responses(q, _forgetful, tries=3, back_off=0.0)
    return predict.response_entities(r, ["X"]).groupBy("entity", "label").agg(F.count("*").alias("n"))


@query("SELECT substr(o_orderpriority, 3) AS name, COUNT(*) AS n FROM orders WHERE starts_with(o_orderpriority, (SELECT left(MIN(o_orderpriority), 2) FROM orders)) GROUP BY ALL")
def prefix_strip(spark, d):
    """Names of one prefix, without it."""
    o = U.table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"))
    prefix = o.agg(F.min("name")).first()[0][:2]
    return E.strip_prefix(o, prefix).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT coalesce(CASE l_linenumber WHEN 1 THEN 'B-X' WHEN 2 THEN 'I-X' END, 'O') AS tag, replace(l_returnflag || ' ' || l_linestatus, ' ', '_') AS value, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def label_lookup(spark, d):
    """Tags of ids by a table, and values without white space."""
    tag = T.label_of(F.create_map(F.lit("1"), F.lit("B-X"), F.lit("2"), F.lit("I-X")), "l_linenumber")
    value = T.sanitize_value(F.concat_ws(" ", "l_returnflag", "l_linestatus"))
    return U.table(spark, d, "lineitem").groupBy(tag.alias("tag"), value.alias("value")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_discount - l_tax > 0.05 THEN 'OVER' WHEN 0.05 - l_discount <= 0.02 THEN 'UNDER' WHEN l_discount - l_tax > 0.02 THEN 'MILD' ELSE 'GOOD' END AS diagnosis, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def fit_diagnosis(spark, d):
    """Loss curves' first, last and least values, here a constant, the discount and the tax."""
    return U.table(spark, d, "lineitem").groupBy(T.fit_diagnosis(F.lit(0.05), "l_discount", "l_tax").alias("diagnosis")).agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT COUNT(*) AS n FROM documents) SELECT 'unused' AS fold, n - (n + 1) // 2 AS n FROM n UNION ALL SELECT 'kept', (n + 1) // 2 FROM n")
def two_phase_split(spark, d):
    """Half of the documents by label sets, cut to folds; the rest is unused."""
    s = X.two_phase_split(_docs(spark, d).select("doc_id", F.col("lang").alias("label")), 0.5, {"train": 0.8, "test": 0.2})
    return s.groupBy(F.when(F.col("fold") == "unused", "unused").otherwise("kept").alias("fold")).agg(F.count("*").alias("n"))
