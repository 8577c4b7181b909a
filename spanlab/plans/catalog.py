"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.functions import stats as S
from spanlab.functions import text as T
from spanlab.functions import udtf
from spanlab.operators import evaluate as E
from spanlab.operators import match as M
from spanlab.operators import metrics as C
from spanlab.operators import routing as R
from spanlab.operators import significance as G
from spanlab.operators import spans as P
from spanlab.operators import splits as X
from spanlab.operators import tokens as K
from spanlab.plans import registry
from spanlab.plans import surrogates as U
from spanlab.plans.registry import query
from spanlab.plans.surrogates import BAGS, COUNTS, FLAGS, GOLD, MATRIX, MENTIONS, PRED, PRF, TAGS
from spanlab.sources import brat, formats, ledger, predict, shared, sinks, standoff

METHODS = ["rules", "TBM", "LLM"]


def queries() -> dict:
    from spanlab.plans import round_trips  # noqa: F401 - registers its queries

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    from spanlab.plans import round_trips  # noqa: F401

    return dict(registry.SQL)


def _docs(spark, d) -> DataFrame:
    return U.table(spark, d, "documents")


def _counts(spark, d) -> DataFrame:
    return M.match_bag(U.gold(spark, d), U.pred(spark, d))


# --- matching and scores -----------------------------------------------------------------------------------------


@query(f"""WITH {COUNTS}, t AS (SELECT COALESCE(label, 'MICRO') AS label, SUM(tp)::BIGINT AS tp, SUM(fp)::BIGINT AS fp, SUM(fn)::BIGINT AS fn FROM counts GROUP BY ROLLUP (label))
SELECT label, tp, fp, fn, {PRF} FROM t""")
def eval_exact_prf(spark, d):
    return E.with_micro(_counts(spark, d))


@query(f"WITH {COUNTS} SELECT * FROM counts")
def match_bag(spark, d):
    return _counts(spark, d)


@query(f"""WITH {BAGS}, t AS (SELECT label, COUNT(*) FILTER (g > 0 AND p > 0) AS tp, COUNT(*) FILTER (g = 0) AS fp, COUNT(*) FILTER (p = 0) AS fn FROM bags GROUP BY label)
SELECT label, tp, fp, fn, {PRF} FROM t""")
def match_set(spark, d):
    return E.per_label(M.match_set(U.gold(spark, d), U.pred(spark, d)))


def _pairs_sql(score: str, t: float) -> str:
    return f"""WITH {GOLD}, {PRED}, pairs AS (SELECT g.doc_id, g.label, g.b AS gb, g.e AS ge, p.b AS pb, p.e AS pe, GREATEST(0, LEAST(g.e, p.e) - GREATEST(g.b, p.b))::DOUBLE AS o FROM gold g JOIN pred p USING (doc_id, label))
SELECT label, COUNT(*) AS n, SUM(gb)::BIGINT AS gb, SUM(pb)::BIGINT AS pb FROM pairs WHERE o > 0 AND {score} >= {t} GROUP BY label"""


def _pairs(spark, d, metric, t) -> DataFrame:
    return M.candidate_pairs(U.gold(spark, d), U.pred(spark, d), metric, t).groupBy("label").agg(F.count("*").alias("n"), F.sum("gb").alias("gb"), F.sum("pb").alias("pb"))


@query(_pairs_sql("o / (ge - gb + pe - pb - o)", 0.5))
def overlap_iou_pairs(spark, d):
    return _pairs(spark, d, "iou", 0.5)


@query(_pairs_sql("o / LEAST(ge - gb, pe - pb)", 0.8))
def overlap_min_pairs(spark, d):
    return _pairs(spark, d, "min", 0.8)


@query(_pairs_sql("o / (ge - gb)", 0.85))
def overlap_gold_pairs(spark, d):
    return _pairs(spark, d, "gold", 0.85)


@query(_pairs_sql("o / (pe - pb)", 0.85))
def overlap_pred_pairs(spark, d):
    return _pairs(spark, d, "pred", 0.85)


@query(_pairs_sql("o / LEAST(ge - gb, pe - pb)", 0.8))
def overlap_bucketed_pairs(spark, d):
    """The same pairs by the ladder of bins, as for documents of very many spans."""
    p = M.candidate_pairs(U.gold(spark, d), U.pred(spark, d), "min", 0.8, width=64)
    return p.groupBy("label").agg(F.count("*").alias("n"), F.sum("gb").alias("gb"), F.sum("pb").alias("pb"))


def _greedy_sql(order: str, grouping: str) -> str:
    """Whole greedy matching: each group's pairs are walked in order; ``took`` lists what each pair took of both multiplicities."""
    return f"""WITH RECURSIVE {GOLD}, {PRED}, g AS (SELECT doc_id, label, b, e, COUNT(*) AS n FROM gold GROUP BY ALL), p AS (SELECT doc_id, label, b, e, COUNT(*) AS n FROM pred GROUP BY ALL),
x AS (SELECT g.doc_id, g.label, g.b AS gb, g.e AS ge, p.b AS pb, p.e AS pe, g.n AS gn, p.n AS pn, (LEAST(g.e, p.e) - GREATEST(g.b, p.b))::DOUBLE / LEAST(g.e - g.b, p.e - p.b) AS score FROM g JOIN p USING (doc_id, label) WHERE LEAST(g.e, p.e) > GREATEST(g.b, p.b)),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, label ORDER BY {order}) AS i FROM x WHERE score >= 0.8),
w(doc_id, label, i, took, tp) AS (SELECT DISTINCT doc_id, label, 0::BIGINT, []::STRUCT(gb INT, ge INT, pb INT, pe INT, k BIGINT)[], 0::BIGINT FROM o
  UNION ALL SELECT doc_id, label, i, list_append(took, {{'gb': gb, 'ge': ge, 'pb': pb, 'pe': pe, 'k': k}}), tp + k FROM (SELECT o.*, w.took, w.tp, LEAST(gn - coalesce(list_sum([t.k for t in took if t.gb = gb AND t.ge = ge]), 0), pn - coalesce(list_sum([t.k for t in took if t.pb = pb AND t.pe = pe]), 0))::BIGINT AS k
    FROM w JOIN o ON o.doc_id = w.doc_id AND o.label = w.label AND o.i = w.i + 1)),
n AS (SELECT label, COUNT(*) AS g, 0 AS p, 0 AS tp FROM gold GROUP BY label UNION ALL SELECT label, 0, COUNT(*), 0 FROM pred GROUP BY label UNION ALL SELECT label, 0, 0, SUM(t) FROM (SELECT label, MAX(tp) AS t FROM w GROUP BY doc_id, label) GROUP BY label),
t AS (SELECT COALESCE(label, 'MICRO') AS label, SUM(tp)::BIGINT AS tp, SUM(p - tp)::BIGINT AS fp, SUM(g - tp)::BIGINT AS fn FROM n GROUP BY {grouping})"""


BEST_FIRST, IN_PLACE = "score DESC, ge - gb, pe - pb, gb, pb", "pb, pe, gb, ge"


@query(f"{_greedy_sql(BEST_FIRST, 'label')} SELECT label, tp, fp, fn FROM t")
def match_overlap_min(spark, d):
    c = M.match_overlap(U.gold(spark, d), U.pred(spark, d), "min", 0.8, width=64)
    return c.groupBy("label").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")))


@query(f"{_greedy_sql(BEST_FIRST, 'ROLLUP (label)')} SELECT label, tp, fp, fn, {PRF} FROM t")
def match_overlap_all(spark, d):
    return E.with_micro(M.match_overlap(U.gold(spark, d), U.pred(spark, d), "min", 0.8))


@query(f"{_greedy_sql(IN_PLACE, 'ROLLUP (label)')} SELECT label, tp, fp, fn, {PRF} FROM t")
def match_first_fit(spark, d):
    return E.with_micro(M.match_first_fit(U.gold(spark, d), U.pred(spark, d), "min", 0.8))


@query(f"""WITH {COUNTS}, t AS (SELECT SUM(tp)::BIGINT AS tp, SUM(fp)::BIGINT AS fp, SUM(fn)::BIGINT AS fn FROM counts) SELECT tp, fp, fn, {PRF} FROM t""")
def eval_micro(spark, d):
    return E.micro(_counts(spark, d))


@query(f"""WITH {COUNTS}, t AS (SELECT label, SUM(tp)::BIGINT AS tp, SUM(fp)::BIGINT AS fp, SUM(fn)::BIGINT AS fn FROM counts GROUP BY label), s AS (SELECT {PRF} FROM t UNION ALL SELECT 0.0, 0.0, 0.0)
SELECT AVG(precision) AS precision, AVG(recall) AS recall, AVG(f1) AS f1 FROM s""")
def eval_macro(spark, d):
    vocabulary = spark.createDataFrame([(x,) for x in ("A", "N", "R", "Absent")], "label string")
    return E.macro(_counts(spark, d), vocabulary)


@query(f"""WITH {COUNTS}, t AS (SELECT SUM(tp)::BIGINT AS tp, SUM(fp)::BIGINT AS fp, SUM(fn)::BIGINT AS fn, label FROM counts GROUP BY label), s AS (SELECT label, {PRF} FROM t), o AS (SELECT 'run' AS model, SUM(tp)::BIGINT AS tp, SUM(fp)::BIGINT AS fp, SUM(fn)::BIGINT AS fn FROM t)
SELECT model, tp, fp, fn, {PRF}, (SELECT f1 FROM s WHERE label = 'A') AS "F1_A", (SELECT f1 FROM s WHERE label = 'N') AS "F1_N", (SELECT f1 FROM s WHERE label = 'R') AS "F1_R" FROM o""")
def eval_wide(spark, d):
    return E.wide_scores(_counts(spark, d).withColumn("model", F.lit("run")), ["A", "N", "R"], ["model"])


@query(f"WITH {GOLD} SELECT label, COUNT(*) AS n FROM gold GROUP BY label")
def gold_counts(spark, d):
    return U.gold(spark, d).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {BAGS} SELECT label, CASE WHEN p > g THEN 'FP' ELSE 'FN' END AS kind, COUNT(*) AS spans, SUM(abs(p - g))::BIGINT AS n, SUM(b)::BIGINT AS b FROM bags WHERE g <> p GROUP BY ALL""")
def error_rows(spark, d):
    return M.errors(U.gold(spark, d), U.pred(spark, d)).groupBy("label", "kind").agg(F.count("*").alias("spans"), F.sum("n").alias("n"), F.sum("begin").alias("b"))


@query(f"""WITH {BAGS}, s AS (SELECT label, e - b AS size, COUNT(*) AS n FROM bags WHERE p > g GROUP BY ALL) SELECT label, size, n, r AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, size) AS r FROM s) WHERE r <= 15""")
def fp_topk(spark, d):
    fp = M.errors(U.gold(spark, d), U.pred(spark, d)).where("kind = 'FP'").withColumn("size", F.col("end") - F.col("begin"))
    return E.top_k(fp, ["label"], "size", 15)


@query(f"""WITH {GOLD}, {PRED}, g AS (SELECT DISTINCT * FROM gold), p AS (SELECT DISTINCT * FROM pred) SELECT g.label, COUNT(*) AS mentions, COUNT(p.b) AS hits FROM g LEFT JOIN p ON g.doc_id = p.doc_id AND g.label = p.label AND g.b = p.b AND g.e = p.e GROUP BY g.label""")
def detection_table(spark, d):
    t = M.detections(U.gold(spark, d), {"rules": U.pred(spark, d)})
    return t.groupBy("label").agg(F.count("*").alias("mentions"), F.sum("rules").alias("hits"))


@query(f"""WITH {PRED}, {GOLD} SELECT COUNT(*) AS n FROM pred WHERE doc_id IN (SELECT doc_id FROM gold WHERE label = 'A')""")
def only_gold_documents(spark, d):
    return M.only_gold_documents(U.pred(spark, d), U.gold(spark, d).where("label = 'A'")).agg(F.count("*").alias("n"))


@query(f"""WITH {GOLD}, {PRED} SELECT (SELECT COUNT(*) FROM (SELECT * FROM gold INTERSECT SELECT * FROM pred)) AS both, (SELECT COUNT(*) FROM (SELECT * FROM gold EXCEPT SELECT * FROM pred)) AS only_gold, (SELECT COUNT(*) FROM (SELECT * FROM gold UNION SELECT * FROM pred)) AS either""")
def set_operations(spark, d):
    g, p = U.gold(spark, d), U.pred(spark, d)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(g.intersect(p), "both").join(n(g.subtract(p), "only_gold")).join(n(g.union(p).distinct(), "either"))


# --- text functions ----------------------------------------------------------------------------------------------


@query("SELECT lang, SUM(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words, COUNT(*) AS docs FROM documents GROUP BY lang")
def word_stats(spark, d):
    return _docs(spark, d).groupBy("lang").agg(F.sum(T.word_count("text")).alias("words"), F.count("*").alias("docs"))


@query("""WITH t AS (SELECT lang, lower(UNNEST(list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda x: x <> ''))) AS token FROM documents), n AS (SELECT lang, token, COUNT(*) AS n FROM t GROUP BY ALL)
SELECT lang, token, n, r AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM n) WHERE r <= 20""")
def token_topk(spark, d):
    return E.top_k(_docs(spark, d).select("lang", F.explode(T.tokens("text")).alias("token")), ["lang"], "token", 20)


SHAPE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'D', 'g'), 'zzz', 'zzz', 'g')"


@query(f"""WITH {MENTIONS}, n AS (SELECT label, {SHAPE} AS shape, COUNT(*) AS n FROM mentions GROUP BY ALL) SELECT label, shape, n, r AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, shape) AS r FROM n) WHERE r <= 5""")
def shape_topk(spark, d):
    return E.top_k(U.mentions(spark, d).withColumn("shape", T.shape("value")), ["label"], "shape", 5)


@query(f"""WITH {MENTIONS}, n AS (SELECT label, regexp_replace(regexp_replace(value, '[A-Z0-9]', 'X', 'g'), '[a-z]', 'x', 'g') AS shape, COUNT(*) AS n FROM mentions GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, shape) AS r FROM n)
SELECT label, SUM(n) FILTER (r <= 3)::DOUBLE / SUM(n) AS coverage FROM r GROUP BY label""")
def shape_coverage_compat(spark, d):
    return E.coverage(U.mentions(spark, d).withColumn("shape", T.shape("value", compat=True)), ["label"], "shape")


@query(f"WITH {MENTIONS} SELECT label, COUNT(*) FILTER (regexp_full_match(value, '(<|>|<=|>=)?\\s*\\d+([.,]\\d+)?\\s*%?')) AS numeric, COUNT(*) AS n FROM mentions GROUP BY label")
def numeric_mentions(spark, d):
    return U.mentions(spark, d).groupBy("label").agg(F.sum(T.is_numeric("value").cast("long")).alias("numeric"), F.count("*").alias("n"))


@query(f"""WITH {MENTIONS}, n AS (SELECT label, value, COUNT(*) AS n FROM mentions GROUP BY ALL) SELECT label, value AS mode, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC, value) AS r FROM n) WHERE r = 1""")
def mode_value(spark, d):
    return E.mode_of(U.mentions(spark, d), ["label"], "value")


@query(f"""WITH {MENTIONS} SELECT label, string_agg(value, '|' ORDER BY value) AS samples FROM (SELECT label, value, ROW_NUMBER() OVER (PARTITION BY label ORDER BY value) AS r FROM (SELECT DISTINCT label, value FROM mentions)) WHERE r <= 20 GROUP BY label""")
def sample_values(spark, d):
    return E.sample_values(U.mentions(spark, d), ["label"], "value")


@query(f"WITH {MENTIONS} SELECT label, COUNT(DISTINCT value) AS n_values, COUNT(DISTINCT doc_id) AS n_docs, COUNT(*) AS n FROM mentions GROUP BY label")
def distinct_counts(spark, d):
    return U.mentions(spark, d).groupBy("label").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n"))


@query(f"WITH {MENTIONS}, t AS (SELECT COUNT(DISTINCT doc_id) AS total_docs FROM documents) SELECT label, COUNT(DISTINCT doc_id) AS docs, ANY_VALUE(total_docs) AS total_docs, COUNT(DISTINCT doc_id)::DOUBLE / ANY_VALUE(total_docs) AS presence_ratio FROM mentions, t GROUP BY label")
def presence_ratio(spark, d):
    return E.presence(U.mentions(spark, d), _docs(spark, d))


@query("SELECT doc_id, translate(substr(text, greatest(10 - 30, 0) + 1, least(length(text), 15 + 30) - greatest(10 - 30, 0)), chr(10), ' ') AS snippet FROM documents")
def snippets(spark, d):
    return _docs(spark, d).select("doc_id", T.snippet("text", F.lit(10), F.lit(15)).alias("snippet"))


@query("SELECT label, list_position(embedding, list_max(embedding)) - 1 AS top, COUNT(*) AS n FROM embeddings GROUP BY ALL")
def argmax_label(spark, d):
    return U.table(spark, d, "embeddings").groupBy("label", T.argmax("embedding").alias("top")).agg(F.count("*").alias("n"))


@query()
def softmax_probability(spark, d):
    return U.table(spark, d, "embeddings").select("vec_id", T.softmax_max("embedding").alias("p"))


@query("SELECT CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END AS band, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def score_bands(spark, d):
    return U.table(spark, d, "lineitem").groupBy(T.band("l_discount", 0.08, 0.04).alias("band")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN l_tax <= 0.001 THEN '***' WHEN l_tax <= 0.01 THEN '**' WHEN l_tax <= 0.05 THEN '*' ELSE 'ns' END AS stars, COUNT(*) AS n FROM lineitem GROUP BY ALL")
def p_stars(spark, d):
    return U.table(spark, d, "lineitem").groupBy(T.stars("l_tax").alias("stars")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS label, COUNT(*) AS n, SUM(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type")
def json_entities(spark, d):
    """Every event's type and props as a model's answer, read back by the response parser."""
    answer = F.concat(F.lit('Here: [{"label": "'), "event_type", F.lit('", "text": "'), F.get_json_object("props", "$.k"), F.lit('"}, {"label": "x"}] done'))
    e = predict.response_entities(U.table(spark, d, "events").select(answer.alias("response")))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("entity").cast("long")).alias("k"))


@query("SELECT p_type, COUNT(*) FILTER (p_size <= 10) AS small, printf('%.1f%%', 100.0 * COUNT(*) FILTER (p_size <= 10) / COUNT(*)) AS share FROM part GROUP BY p_type")
def percent_fields(spark, d):
    n = F.sum((F.col("p_size") <= 10).cast("long"))
    return U.table(spark, d, "part").groupBy("p_type").agg(n.alias("small"), E.percent_text(n / F.count("*")).alias("share"))


@query("""SELECT doc_id, sha256(trim(regexp_replace(strip_accents(lower(text)), '[\\s\\x0B\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'), ' ')) AS sha256 FROM documents WHERE text IS NOT NULL""")
def normalized_text(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha2(T.normalized("text"), 256).alias("sha256"))


@query("""WITH p AS (SELECT p_partkey % 5 AS k, p_size::VARCHAR AS n, p_size, p_partkey // 5 AS m FROM part),
v AS (SELECT 'HER2_IHC' AS label, CASE WHEN p_size % 4 = 0 THEN '0' ELSE (p_size % 4) || '+' END AS value FROM p WHERE k = 0 UNION ALL SELECT 'HER2_status', CASE WHEN m % 2 = 0 THEN 'negatif' ELSE 'positif' END FROM p WHERE k = 0
  UNION ALL SELECT CASE k WHEN 1 THEN 'Estrogen_receptor' ELSE 'Progesterone_receptor' END, CASE WHEN p_size > 10 THEN 'positif' ELSE 'negatif' END FROM p WHERE k IN (1, 2)
  UNION ALL SELECT 'Ki67', n || '%' FROM p WHERE k = 3 UNION ALL SELECT 'HER2_FISH', CASE p_size % 3 WHEN 0 THEN 'negatif' WHEN 1 THEN 'positif' ELSE 'en_cours' END FROM p WHERE k = 4)
SELECT label, value, COUNT(*) AS n FROM v GROUP BY ALL""")
def biomarker_values(spark, d):
    """Every part as a finding, whose text the value parsers read."""
    k, m, n = F.col("p_partkey") % 5, F.floor(F.col("p_partkey") / 5), F.col("p_size")
    fish = F.when(n % 3 == 0, "FISH non amplifié").when(n % 3 == 1, "FISH amplifié").otherwise("FISH en  cours")
    text = (
        F.when(k == 0, F.concat(F.lit("HER2 "), F.when(m % 2 == 0, "Négatif").otherwise("POSITIF"), F.lit(" score "), (n % 4).cast("string"), F.lit("+")))
        .when(k == 1, F.concat(F.lit("RE "), n.cast("string"), F.lit(" %"))).when(k == 2, F.concat(F.lit("RP : "), n.cast("string"), F.lit("%")))
        .when(k == 3, F.concat(F.lit("Ki 67 : "), n.cast("string"), F.lit(" %"))).otherwise(fish)
    )
    label = F.element_at(F.array(*(F.lit(x) for x in ("HER2", "ER", "PR", "Ki67", "FISH"))), k.cast("int") + 1)
    findings = U.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), label.alias("label"), text.alias("text"))
    return P.emit_values(findings).groupBy("label", "value").agg(F.count("*").alias("n"))


# --- metrics -----------------------------------------------------------------------------------------------------


@query(f"""WITH {MENTIONS}, m AS (SELECT label, trim(value) AS value FROM mentions),
f AS (SELECT label, COUNT(*) AS count, AVG((contains(value, '%'))::INT) > 0.7 AS a, COUNT(*) FILTER (regexp_matches(value, '[+\\-]'))::DOUBLE / COUNT(*) > 0.5 AS b, COUNT(*) FILTER (regexp_matches(lower(value), 'score\\s*:?\\s*\\d'))::DOUBLE / COUNT(*) > 0.3 AS c,
  COUNT(*) FILTER (regexp_matches(lower(value), '{C.STATUS_WORDS}'))::DOUBLE / COUNT(*) > 0.4 AS d, COUNT(*) FILTER (regexp_matches(value, '>|<|\\d+\\s*-\\s*\\d+'))::DOUBLE / COUNT(*) > 0.2 AS e FROM m GROUP BY label),
s3 AS (SELECT label, SUM(n) FILTER (r <= 3)::DOUBLE / SUM(n) AS top3 FROM (SELECT label, n, ROW_NUMBER() OVER (PARTITION BY label ORDER BY n DESC) AS r FROM (SELECT label, {SHAPE} AS s, COUNT(*) AS n FROM m GROUP BY ALL)) GROUP BY label),
st AS (SELECT label, MAX(n)::DOUBLE / SUM(n) AS start FROM (SELECT label, left(value, 2) AS s, COUNT(*) AS n FROM m WHERE length(value) >= 2 GROUP BY ALL) GROUP BY label),
fi AS (SELECT label, MAX(n)::DOUBLE / SUM(n) AS finish FROM (SELECT label, right(value, 1) AS s, COUNT(*) AS n FROM m WHERE length(value) >= 1 GROUP BY ALL) GROUP BY label),
j AS (SELECT *, a::BIGINT + b::BIGINT + c::BIGINT + d::BIGINT + e::BIGINT + (start > 0.5)::BIGINT + (finish > 0.5)::BIGINT AS formats FROM f JOIN s3 USING (label) JOIN st USING (label) JOIN fi USING (label))
SELECT label, count, top3, start, finish, formats, LEAST(top3 * 0.7::DOUBLE + LEAST(formats * 0.15::DOUBLE, 0.4::DOUBLE) + CASE WHEN start > 0.8 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) AS te FROM j""")
def templeability(spark, d):
    return C.templeability(U.mentions(spark, d))


@query(f"""WITH {MENTIONS}, m AS (SELECT label, lower(trim(value)) AS v, regexp_replace(lower(trim(value)), '[^a-z0-9+\\-%]', '', 'g') AS c FROM mentions),
k AS (SELECT *, v IN {C.AMBIGUOUS} OR c IN {C.AMBIGUOUS} AS listed, regexp_matches(v, '^(<|>|<=|>=)?\\s*\\d+([.,]\\d+)?\\s*%?$') AS num, contains(' ' || regexp_replace(v, '[^\\pL\\pN_]', ' ', 'g') || ' ', ' ' || label || ' ') AS explicit FROM m),
z AS (SELECT *, NOT listed AND num AS numeric, (listed OR num) AND NOT explicit AS risk FROM k)
SELECT label, COUNT(*) AS count, COUNT(*) FILTER (risk)::DOUBLE / COUNT(*) AS r, COUNT(*) FILTER (listed)::DOUBLE / COUNT(*) AS polysemic_ratio, COUNT(*) FILTER (numeric)::DOUBLE / COUNT(*) AS numeric_ratio, COUNT(*) FILTER (explicit)::DOUBLE / COUNT(*) AS explicit_ratio,
  COUNT(*) FILTER (NOT risk AND NOT explicit AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') AND length(v) > 3 AND NOT regexp_matches(v, '^(score|grade|stade)\\s*:?\\s*\\d'))::DOUBLE / COUNT(*) AS structured_ratio FROM z GROUP BY label""")
def risk_score(spark, d):
    return C.risk(U.mentions(spark, d))


@query("""WITH t AS (SELECT lang AS label, lower(UNNEST(list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda x: x <> ''))) AS token FROM documents), s AS (SELECT label, COUNT(*) AS n_tokens, COUNT(DISTINCT token) AS n_unique FROM t GROUP BY label)
SELECT label, n_tokens, n_unique, (n_tokens - n_unique)::DOUBLE / n_tokens AS he, 1 / (1 + exp(-10.0::DOUBLE * ((n_tokens - n_unique)::DOUBLE / n_tokens - 0.5::DOUBLE))) AS he_score FROM s""")
def homogeneity(spark, d):
    return C.homogeneity(_docs(spark, d).select(F.col("lang").alias("label"), F.col("text").alias("value")))


@query(f"""WITH {MENTIONS}, w AS (SELECT SUM(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')))::BIGINT AS total_words FROM documents), c AS (SELECT label, COUNT(*) AS count FROM mentions GROUP BY label) SELECT label, count, total_words, count::DOUBLE / total_words AS freq FROM c, w""")
def entity_frequency(spark, d):
    return C.frequency(U.mentions(spark, d), _docs(spark, d))


@query("""WITH f AS (SELECT source AS dir, CAST(substr(source, 4) AS INT) AS priority, doc_id % 700 AS name FROM documents), m AS (SELECT name, MIN(priority) AS p FROM f GROUP BY name), t AS (SELECT COUNT(*) AS total FROM m)
SELECT dir, priority, COUNT(DISTINCT name) AS files, COUNT(DISTINCT CASE WHEN priority = p THEN name END) AS new_files, ANY_VALUE(total) AS total, CASE WHEN ANY_VALUE(total) > 500 THEN 'fine-tune all' ELSE 'not enough' END AS decision FROM f JOIN m USING (name), t GROUP BY dir, priority""")
def feasibility(spark, d):
    files = _docs(spark, d).select(F.col("source").alias("dir"), F.substring("source", 4, 9).cast("int").alias("priority"), (F.col("doc_id") % 700).alias("name"))
    return C.feasibility(files)


@query("WITH f AS (SELECT source, doc_id % 700 AS name, CAST(substr(source, 4) AS INT) AS priority FROM documents) SELECT name, MIN(priority) AS priority, COUNT(*) AS n FROM (SELECT *, MIN(priority) OVER (PARTITION BY name) AS m FROM f) WHERE priority = m GROUP BY name")
def prioritized_union(spark, d):
    f = _docs(spark, d).select((F.col("doc_id") % 700).alias("name"), F.substring("source", 4, 9).cast("int").alias("priority"))
    return brat.first_directory(f).groupBy("name", "priority").agg(F.count("*").alias("n"))


TRACE_SQL = """CASE WHEN a THEN 'regular' ELSE 'irregular -> ' || CASE WHEN b THEN 'learnable' ELSE 'not learnable -> ' || CASE WHEN c THEN 'data or low risk' ELSE 'rare and risky -> ' || CASE WHEN e THEN 'needs context' ELSE 'default' END END END END"""


@query(f"""WITH te AS ({registry.SQL["templeability"]}), ri AS ({registry.SQL["risk_score"]}), fr AS ({registry.SQL["entity_frequency"]}),
tok AS (WITH {MENTIONS} SELECT label, lower(UNNEST(list_filter(string_split_regex(value, '[^a-zA-Z0-9%]+'), lambda x: x <> ''))) AS token FROM mentions),
ho AS (SELECT label, (COUNT(*) - COUNT(DISTINCT token))::DOUBLE / COUNT(*) AS he FROM tok GROUP BY label),
j AS (SELECT label, te, r, he, freq, fr.count AS count FROM te JOIN (SELECT label, r FROM ri) USING (label) JOIN ho USING (label) JOIN fr USING (label)),
k AS (SELECT *, te > 0.5 AND he > 0.5 AND r < 0.3 AS a, te > 0.2 AND te <= 0.5 AND freq > 0.001 AND count > 50 AS b, freq > 0.001 OR r < 0.8 AS c, r > 0.6 AND te < 0.2 AS e FROM j)
SELECT label, te, r, he, freq, count, CASE WHEN a THEN 'rules' WHEN b THEN 'light ML' WHEN c THEN 'transformer' WHEN e THEN 'LLM' ELSE 'rules (default)' END AS method, {TRACE_SQL} AS trace FROM k""")
def metric_chain(spark, d):
    """Templeability, risk, homogeneity and frequency joined by label, then the decision tree; one plan, one scan for the mentions."""
    m = C.counted(U.mentions(spark, d))
    return R.decision_tree(C.metric_table(C.templeability(m), C.risk(m), C.homogeneity(m), C.frequency(m, _docs(spark, d))))


TREE_SQL = """CASE WHEN te > 0.5 AND he > 0.5 AND r < 0.3 THEN 'rules' WHEN te > 0.2 AND te <= 0.5 AND freq > 0.001 AND count > 50 THEN 'light ML' WHEN freq > 0.001 OR r < 0.8 THEN 'transformer' WHEN r > 0.6 AND te < 0.2 THEN 'LLM' ELSE 'rules (default)' END"""


@query(f"""WITH m AS (SELECT p_partkey AS label, (p_size * 7 % 10) / 10.0 AS te, (p_size * 3 % 10) / 10.0 AS he, (p_partkey % 11) / 10.0 AS r, (p_partkey % 3) / 1000.0 AS freq, p_partkey % 97 AS count FROM part) SELECT {TREE_SQL} AS method, COUNT(*) AS n, SUM(label)::BIGINT AS labels FROM m GROUP BY ALL""")
def decision_tree(spark, d):
    p = U.table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    m = p.select(k.alias("label"), ((s * 7 % 10) / 10.0).alias("te"), ((s * 3 % 10) / 10.0).alias("he"), ((k % 11) / 10.0).alias("r"), ((k % 3) / 1000.0).alias("freq"), (k % 97).alias("count"))
    return R.decision_tree(m).groupBy("method").agg(F.count("*").alias("n"), F.sum("label").alias("labels"))


# --- significance and routing ------------------------------------------------------------------------------------


COCHRAN = f"""{FLAGS}, c AS (SELECT label, COUNT(*) AS n, SUM(rules)::BIGINT AS a, SUM(tbm)::BIGINT AS b, SUM(llm)::BIGINT AS c, COUNT(*) FILTER (rules + tbm + llm > 0) AS n_effective, SUM(rules + tbm + llm)::BIGINT AS t, SUM((rules + tbm + llm) * (rules + tbm + llm))::BIGINT AS rr FROM flags GROUP BY label),
q AS (SELECT *, (2 * (3 * (a * a + b * b + c * c) - t * t))::DOUBLE / (3 * t - rr) AS q FROM c)"""


@query(f"""WITH {COCHRAN} SELECT label, n, a AS hits_rules, b AS "hits_TBM", c AS "hits_LLM", a::DOUBLE / n AS recall_rules, b::DOUBLE / n AS "recall_TBM", c::DOUBLE / n AS "recall_LLM", n_effective, q, exp(-q / 2) AS p FROM q""")
def cochran_q(spark, d):
    return G.cochran(U.flags(spark, d), METHODS)


@query(f"""WITH {FLAGS}, e AS (SELECT label, UNNEST([{{'a': 'rules', 'b': 'TBM', 'x': rules, 'y': tbm}}, {{'a': 'rules', 'b': 'LLM', 'x': rules, 'y': llm}}, {{'a': 'TBM', 'b': 'LLM', 'x': tbm, 'y': llm}}], recursive := true) FROM flags)
SELECT label, a, b, COUNT(*) FILTER (x = 1 AND y = 1) AS n11, COUNT(*) FILTER (x = 1 AND y = 0) AS n10, COUNT(*) FILTER (x = 0 AND y = 1) AS n01, COUNT(*) FILTER (x = 0 AND y = 0) AS n00 FROM e GROUP BY ALL""")
def contingency(spark, d):
    return G.contingency(U.flags(spark, d), [("rules", "TBM"), ("rules", "LLM"), ("TBM", "LLM")])


@query("""WITH p AS (SELECT p_partkey, (p_partkey % 13)::BIGINT AS b, (p_partkey % 11)::BIGINT AS c FROM part), k AS (SELECT DISTINCT b, c FROM p),
t AS (SELECT b, c, SUM((factorial((b + c)::INT) / (factorial(i::INT) * factorial((b + c - i)::INT)))::DOUBLE) AS s FROM (SELECT b, c, UNNEST(range(0, LEAST(b, c) + 1)) AS i FROM k) GROUP BY ALL)
SELECT b, c, COUNT(*) AS n, CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE LEAST(1.0::DOUBLE, 2 * ANY_VALUE(s) / pow(2.0::DOUBLE, b + c)) END AS p FROM p JOIN t USING (b, c) GROUP BY b, c""")
def mcnemar_exact(spark, d):
    p = U.table(spark, d, "part").select((F.col("p_partkey") % 13).alias("b"), (F.col("p_partkey") % 11).alias("c"))
    n = p.groupBy("b", "c").agg(F.count("*").alias("n"))
    return n.withColumn("p", S.mcnemar_exact(F.col("b"), F.col("c")))


@query()
def mcnemar_pairs(spark, d):
    return G.mcnemar(U.flags(spark, d), METHODS)


@query(f"""WITH {MATRIX}, r AS (SELECT label, f1_rules, f1_tbm, f1_llm,
  1.0::DOUBLE + (f1_tbm < f1_rules)::INT + (f1_llm < f1_rules)::INT + 0.5::DOUBLE * ((f1_tbm = f1_rules)::INT + (f1_llm = f1_rules)::INT) AS a,
  1.0::DOUBLE + (f1_rules < f1_tbm)::INT + (f1_llm < f1_tbm)::INT + 0.5::DOUBLE * ((f1_rules = f1_tbm)::INT + (f1_llm = f1_tbm)::INT) AS b,
  1.0::DOUBLE + (f1_rules < f1_llm)::INT + (f1_tbm < f1_llm)::INT + 0.5::DOUBLE * ((f1_rules = f1_llm)::INT + (f1_tbm = f1_llm)::INT) AS c,
  CASE WHEN f1_rules = f1_tbm AND f1_tbm = f1_llm THEN 24 WHEN f1_rules = f1_tbm OR f1_tbm = f1_llm OR f1_rules = f1_llm THEN 6 ELSE 0 END AS t FROM matrix),
g AS (SELECT label, COUNT(*) AS n, SUM(a) AS a, SUM(b) AS b, SUM(c) AS c, SUM(t)::DOUBLE AS t FROM r GROUP BY label),
q AS (SELECT label, n, (12.0::DOUBLE / (n * 3 * 4) * (pow(a, 2) + pow(b, 2) + pow(c, 2)) - 3 * n * 4) / (1 - t / (24 * n)) AS chi2 FROM g) SELECT label, n AS n_docs, chi2, CASE WHEN chi2 IS NULL THEN 1.0::DOUBLE ELSE exp(-chi2 / 2) END AS p FROM q""")
def friedman_chi2(spark, d):
    f = G.friedman(G.score_matrix(U.scores(spark, d), METHODS), METHODS)
    return f.select("label", "n_docs", "chi2", "p")


def _mean_sql(c: str) -> str:
    return f"list_reduce(list_prepend(0.0::DOUBLE, list(v * n::DOUBLE ORDER BY v) FILTER (m = '{c}')), lambda a, x: a + x) / SUM(n) FILTER (m = '{c}') AS mean_{c}"


@query(f"""WITH {MATRIX}, l AS (SELECT label, 'rules' AS m, f1_rules AS v FROM matrix UNION ALL SELECT label, 'tbm', f1_tbm FROM matrix UNION ALL SELECT label, 'llm', f1_llm FROM matrix),
c AS (SELECT label, m, v, COUNT(*) AS n FROM l GROUP BY ALL) SELECT label, (SUM(n) FILTER (m = 'rules'))::BIGINT AS n_docs, {_mean_sql("rules")}, {_mean_sql("tbm")}, {_mean_sql("llm")} FROM c GROUP BY label""")
def mean_scores(spark, d):
    return G.mean_scores(G.score_matrix(U.scores(spark, d), METHODS), METHODS).withColumnsRenamed({"mean_TBM": "mean_tbm", "mean_LLM": "mean_llm"})


@query(f"""WITH {MATRIX}, c AS (SELECT label, f1_rules - f1_tbm AS v, COUNT(*) AS n FROM matrix GROUP BY ALL), s AS (SELECT label, SUM(n)::BIGINT AS n, list_reduce(list_prepend(0.0::DOUBLE, list(v * n::DOUBLE ORDER BY v)), lambda a, x: a + x) / SUM(n) AS mean FROM c GROUP BY label),
z AS (SELECT label, ANY_VALUE(s.n) AS n, ANY_VALUE(mean) AS mean, list_reduce(list_prepend(0.0::DOUBLE, list((v - mean) * (v - mean) * c.n::DOUBLE ORDER BY v)), lambda a, x: a + x) AS ss FROM c JOIN s USING (label) GROUP BY label)
SELECT label, n, CASE WHEN n > 1 AND ss > 0 THEN mean / sqrt(ss / (n - 1) / n) END AS t FROM z""")
def paired_t(spark, d):
    return G.paired_t_statistic(G.score_matrix(U.scores(spark, d), METHODS), "rules", "TBM")


@query(f"""WITH {MATRIX}, d AS (SELECT label, f1_rules - f1_llm AS d FROM matrix WHERE f1_rules <> f1_llm), r AS (SELECT *, RANK() OVER (PARTITION BY label ORDER BY abs(d)) + (COUNT(*) OVER (PARTITION BY label, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d)
SELECT label, COUNT(*) AS n, LEAST(SUM(CASE WHEN d > 0 THEN r ELSE 0 END), SUM(CASE WHEN d < 0 THEN r ELSE 0 END))::DOUBLE AS w FROM r GROUP BY label""")
def signed_rank(spark, d):
    return G.signed_rank_statistic(G.score_matrix(U.scores(spark, d), METHODS), "rules", "LLM")


@query()
def paired_tests(spark, d):
    return G.paired_tests(G.score_matrix(U.scores(spark, d), METHODS), METHODS)


@query()
def route_documents(spark, d):
    return R.route_documents(G.score_matrix(U.scores(spark, d), METHODS), METHODS)


#: The value above which chi-square of one degree of freedom has the probability 0.05 / 3.
CHI2_PAIR = NormalDist().inv_cdf(1 - 0.05 / 6) ** 2
PAIR_SQL = " UNION ALL ".join(f"SELECT label, '{x}' AS x, '{y}' AS y, COUNT(*) FILTER ({a} = 1 AND {b} = 0) AS b, COUNT(*) FILTER ({a} = 0 AND {b} = 1) AS c FROM flags GROUP BY label" for x, y, a, b in (("rules", "TBM", "rules", "tbm"), ("rules", "LLM", "rules", "llm"), ("TBM", "LLM", "tbm", "llm")))


@query(f"""WITH {FLAGS}, s AS (SELECT label, COUNT(*) AS n, SUM(rules) AS a, SUM(tbm) AS b, SUM(llm) AS c, COUNT(*) FILTER (rules + tbm + llm > 0) AS ne, SUM(rules + tbm + llm) AS h, SUM((rules + tbm + llm) * (rules + tbm + llm)) AS hh FROM flags GROUP BY label),
q AS (SELECT label, n, ne, h, CASE WHEN 3 * h > hh THEN (2 * (3 * (a * a + b * b + c * c) - h * h))::DOUBLE / (3 * h - hh) END AS q FROM s), pairs AS ({PAIR_SQL}),
z AS (SELECT *, CASE WHEN b + c = 0 THEN FALSE WHEN b + c < 25 THEN 2 * list_sum(list_transform(range(0, LEAST(b, c) + 1), lambda i: (factorial((b + c)::INT) / (factorial(i::INT) * factorial((b + c - i)::INT)))::DOUBLE)) / pow(2.0::DOUBLE, b + c) <= 0.05 / 3
  ELSE pow(abs(b - c) - 1, 2)::DOUBLE / (b + c) >= {CHI2_PAIR!r} END AS sure FROM pairs),
v AS (SELECT label, winner, COUNT(*) AS wins FROM (SELECT label, CASE WHEN b >= c THEN x ELSE y END AS winner FROM z WHERE sure) GROUP BY ALL),
m AS (SELECT label, winner FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY wins DESC, list_position(['rules', 'TBM', 'LLM'], winner)) AS r FROM v) WHERE r = 1),
d AS (SELECT label, n, q, winner, CASE WHEN n < 10 THEN 'excluded' WHEN h = 0 OR h = 3 * n THEN 'no variance' WHEN ne < 10 THEN 'few effective rows' WHEN q IS NULL OR exp(-q / 2) > 0.05 THEN 'not significant' WHEN winner IS NULL THEN 'no significant pair' ELSE 'vote' END AS why FROM q LEFT JOIN m USING (label))
SELECT label, n, CASE WHEN why IN ('excluded', 'no variance', 'few effective rows') THEN NULL ELSE q END AS q, CASE WHEN why IN ('excluded', 'no variance', 'few effective rows') THEN NULL ELSE exp(-q / 2) END AS p,
  CASE why WHEN 'excluded' THEN NULL WHEN 'vote' THEN winner ELSE 'rules' END AS method, why FROM d""")
def route_mentions(spark, d):
    return R.route_mentions(U.flags(spark, d), METHODS)


@query("""WITH p AS (SELECT l_orderkey AS label, CASE l_linenumber % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'TBM' ELSE 'LLM' END AS winner, l_discount >= 0.05 AS s FROM lineitem),
w AS (SELECT label, COUNT(*) FILTER (s AND winner = 'rules') AS a, COUNT(*) FILTER (s AND winner = 'TBM') AS b, COUNT(*) FILTER (s AND winner = 'LLM') AS c FROM p GROUP BY label)
SELECT CASE WHEN a >= b AND a >= c THEN 'rules' WHEN b >= c THEN 'TBM' ELSE 'LLM' END AS method, COUNT(*) AS n FROM w GROUP BY ALL""")
def route_frugal(spark, d):
    l = U.table(spark, d, "lineitem")  # noqa: E741
    w = F.when(F.col("l_linenumber") % 3 == 0, "rules").when(F.col("l_linenumber") % 3 == 1, "TBM").otherwise("LLM")
    p = l.select(F.col("l_orderkey").alias("label"), w.alias("winner"), (F.col("l_discount") >= 0.05).alias("significant"))
    return R.vote(p, METHODS).groupBy("method").agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({registry.SQL["friedman_chi2"]}) SELECT COUNT(*) FILTER (n_docs >= 10) AS n_tested, COUNT(*) FILTER (n_docs >= 10 AND p <= 0.05) AS n_significant FROM f""")
def run_summary(spark, d):
    return R.run_summary(G.friedman(G.score_matrix(U.scores(spark, d), METHODS), METHODS), "n_docs")


def _hits_only(spark, d):
    """Scores that count hits alone, so that documents without any count nothing."""
    return U.scores(spark, d).withColumn("fn", F.lit(0).cast("long"))


@query(f"""WITH {FLAGS}, d AS (SELECT label, doc_id, SUM(rules + tbm + llm) AS n FROM flags GROUP BY ALL) SELECT label, COUNT(*) FILTER (n = 0) AS n_excluded FROM d GROUP BY label""")
def excluded_counts(spark, d):
    return G.excluded_counts(_hits_only(spark, d))


@query(f"""WITH {MATRIX} SELECT label, AVG((f1_rules + f1_tbm + f1_llm = 0)::INT::DOUBLE) AS sparsity FROM matrix GROUP BY label""")
def sparsity(spark, d):
    return G.sparsity(G.score_matrix(U.scores(spark, d), METHODS), METHODS)


@query(f"""WITH f AS ({registry.SQL["friedman_chi2"]}) SELECT label, n_docs FROM f WHERE n_docs >= 10 AND p <= 0.05""")
def significant_labels(spark, d):
    return G.significant_labels(G.friedman(G.score_matrix(U.scores(spark, d), METHODS), METHODS)).select("label", "n_docs")


@query("""WITH b AS (SELECT s_nationkey AS doc_id, s_suppkey AS label, s_suppkey % 7 AS tp, 0 AS fp, s_suppkey % 3 AS fn FROM supplier) SELECT doc_id, COUNT(*) AS labels, SUM(tp)::BIGINT AS tp, SUM(fn)::BIGINT AS fn FROM b GROUP BY doc_id""")
def score_cache(spark, d):
    """Scores written as JSON a document, and read again."""
    s = U.table(spark, d, "supplier").select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("label"), (F.col("s_suppkey") % 7).alias("tp"), F.lit(0).cast("long").alias("fp"), (F.col("s_suppkey") % 3).alias("fn"))
    kind = "map<string,map<string,struct<TP:bigint,FP:bigint,FN:bigint>>>"
    e = sinks.score_cache(s).select("doc_id", F.explode(F.element_at(F.map_values(F.from_json("json", kind)), 1)).alias("label", "c"))
    return e.groupBy("doc_id").agg(F.count("*").alias("labels"), F.sum("c.TP").alias("tp"), F.sum("c.FN").alias("fn"))


@query(f"""WITH {TAGS} SELECT doc_id, COUNT(*) AS n, sha256(string_agg('e' || event_id || '=' || tag, ',' ORDER BY event_id)) AS sha256 FROM tags GROUP BY doc_id""")
def bio_json(spark, d):
    """Tagged tokens written as JSON a document, and read again."""
    t = U.tags(spark, d).select("doc_id", F.col("event_id").alias("tok_id"), F.format_string("e%d", "event_id").alias("token"), "tag")
    j = sinks.bio_json(t).select("doc_id", F.from_json("json", "id string, tokens array<string>, ner_tags array<string>").alias("j"))
    text = F.array_join(F.zip_with("j.tokens", "j.ner_tags", lambda a, b: F.concat_ws("=", a, b)), ",")
    return j.select("doc_id", F.size("j.tokens").cast("long").alias("n"), F.sha2(text, 256).alias("sha256"))


@query("""SELECT corpus, COUNT(*) AS n, SUM(doc_id)::BIGINT AS ids FROM (SELECT 'a' AS corpus, doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT 'b', doc_id FROM documents) GROUP BY corpus""")
def all_directories(spark, d):
    docs = _docs(spark, d).select("doc_id", "lang")
    return brat.all_directories({"a": docs.where("lang = 'en'"), "b": docs}).groupBy("corpus").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x)))::BIGINT AS chars FROM documents WHERE regexp_matches(text, '[0-9]')""")
def sql_extract_spans(spark, d):
    """Spans by the SQL table function."""
    udtf.register(spark)
    _docs(spark, d).select("doc_id", "text").createOrReplaceTempView("spanlab_documents")
    return spark.sql("SELECT doc_id, COUNT(*) AS n, SUM(s.end - s.begin) AS chars FROM spanlab_documents d, LATERAL extract_spans(d.text, '[0-9]+', 'NUMBER') s GROUP BY doc_id")


# --- tokens and spans --------------------------------------------------------------------------------------------


@query(f"WITH {TAGS} SELECT doc_id, label, first, last, n FROM bio")
def bio_to_spans(spark, d):
    return K.bio_spans(U.tags(spark, d).drop("score"), order=["ts", "event_id"]).select("doc_id", "label", "first", "last", "n")


@query(f"WITH {TAGS} SELECT label, COUNT(*) AS spans, SUM(n)::BIGINT AS tokens FROM bio GROUP BY label")
def token_stats(spark, d):
    return K.bio_spans(U.tags(spark, d).drop("score"), order=["ts", "event_id"]).groupBy("label").agg(F.count("*").alias("spans"), F.sum("n").alias("tokens"))


@query("""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda x: x <> '')) AS token, generate_subscripts(list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda x: x <> ''), 1) - 1 AS tok_id FROM documents),
o AS (SELECT doc_id, tok_id, length(token) AS n, SUM(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY tok_id) - 1 AS e FROM t) SELECT doc_id, COUNT(*) AS tokens, SUM(e - n)::BIGINT AS begins, SUM(e)::BIGINT AS ends FROM o GROUP BY doc_id""")
def char_offsets(spark, d):
    t = _docs(spark, d).select("doc_id", F.posexplode(T.tokens("text", lower=False)).alias("tok_id", "token"))
    return K.offsets_of(t).groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("begin").alias("begins"), F.sum("end").alias("ends"))


@query(f"""WITH {GOLD}, s AS (SELECT DISTINCT doc_id, b, e FROM gold), k AS (SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = a.doc_id AND x.b <= a.b AND x.e >= a.e AND (x.b <> a.b OR x.e <> a.e))) SELECT g.label, COUNT(*) AS n, SUM(g.b)::BIGINT AS b FROM gold g JOIN k USING (doc_id, b, e) GROUP BY g.label""")
def drop_nested(spark, d):
    return P.drop_nested(U.gold(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.sum("begin").alias("b"))


@query(f"WITH {GOLD} SELECT label, COUNT(*) AS n FROM (SELECT DISTINCT * FROM gold) GROUP BY label")
def dedup_exact(spark, d):
    g = U.gold(spark, d).withColumns({"priority": F.lit(1), "text": F.lit("")})
    return P.resolve_overlaps(g, mode="keep_nested").groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {GOLD}, o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY b % 7 DESC, b - e, b, label) AS i FROM gold),
w(doc_id, i, kept, label, b, stays) AS (SELECT doc_id, 0::BIGINT, []::STRUCT(b INT, e INT)[], '', 0, FALSE FROM (SELECT DISTINCT doc_id FROM gold)
  UNION ALL SELECT doc_id, i, CASE WHEN stays THEN list_append(kept, {{'b': b, 'e': e}}) ELSE kept END, label, b, stays FROM (SELECT o.*, w.kept, len([k for k in w.kept if k.b < o.e AND o.b < k.e]) = 0 AS stays FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1))
SELECT label, COUNT(*) AS n, SUM(b)::BIGINT AS b FROM w WHERE stays GROUP BY label""")
def resolve_overlaps(spark, d):
    g = U.gold(spark, d).withColumns({"priority": (F.col("begin") % 7).cast("int"), "text": F.lit("")})
    return P.resolve_overlaps(g).groupBy("label").agg(F.count("*").alias("n"), F.sum("begin").alias("b"))


@query("""WITH gold AS (SELECT l_orderkey AS doc_id, l_returnflag AS label, CAST(l_partkey % 500 AS INT) AS b, CAST(l_partkey % 500 AS INT) + CAST(l_quantity AS INT) AS e, (l_suppkey % 9)::DOUBLE AS score FROM lineitem),
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY b, e, label, score) AS i FROM gold), p AS (SELECT *, LAG(label) OVER (PARTITION BY doc_id ORDER BY i) AS pl FROM o),
s AS (SELECT *, SUM(CASE WHEN pl <> label THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM p), f AS (SELECT *, MAX(e) OVER (PARTITION BY doc_id, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
m AS (SELECT *, SUM(CASE WHEN b > far THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, s ORDER BY i) AS m FROM f),
r AS (SELECT label, list_reduce(list({'b': b::DOUBLE, 'e': e::DOUBLE, 's': score} ORDER BY i), lambda a, x: {'b': a.b, 'e': greatest(a.e, x.e), 's': (a.s * (a.e - a.b) + x.s * (x.e - x.b)) / ((a.e - a.b) + (x.e - x.b))}) AS z FROM m GROUP BY doc_id, label, s, m)
SELECT label, COUNT(*) AS n, SUM(z.b)::BIGINT AS b, SUM(z.e)::BIGINT AS e, SUM(floor(z.s * 1000000))::BIGINT AS micros, COUNT(DISTINCT z.s) AS scores FROM r GROUP BY label""")
def merge_adjacent(spark, d):
    l = U.table(spark, d, "lineitem")  # noqa: E741
    b = (F.col("l_partkey") % 500).cast("int")
    g = l.select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("label"), b.alias("begin"), (b + F.col("l_quantity").cast("int")).alias("end"), (F.col("l_suppkey") % 9).cast("double").alias("score"))
    micros = F.sum(F.floor(F.col("score") * 1_000_000)).alias("micros")
    return P.merge_adjacent(g).groupBy("label").agg(F.count("*").alias("n"), F.sum("begin").alias("b"), F.sum("end").alias("e"), micros, F.countDistinct("score").alias("scores"))


#: Words looked for in every document; some lie in others, and each document's language is one more.
SOUGHT = ("the", "he", "an", "and", "in", "ing", "e a")
NEEDLES = f"needles AS (SELECT doc_id, lower(text) AS t, UNNEST(list_concat({list(SOUGHT)}, [lang])) AS entity FROM documents)"


@query(f"""WITH {NEEDLES}, p AS (SELECT doc_id, entity, UNNEST(range(1, greatest(length(t) - length(entity) + 2, 1))) AS i, t FROM needles) SELECT doc_id, entity, COUNT(*) AS n, SUM(i - 1)::BIGINT AS begins FROM p WHERE substr(t, i, length(entity)) = entity GROUP BY doc_id, entity""")
def find_entities(spark, d):
    """A list of entities a document, found by one walk over its text."""
    docs = _docs(spark, d).select("doc_id", "text", "lang")
    e = docs.select("doc_id", F.explode(F.concat(F.array(*(F.lit(x.upper()) for x in SOUGHT)), F.array("lang"))).alias("entity"))
    found = P.find_entities(docs, e)
    return found.groupBy("doc_id", F.lower("entity").alias("entity")).agg(F.count("*").alias("n"), F.sum("begin").alias("begins"))


@query("""WITH x AS (SELECT doc_id, list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda w: w <> '') AS a FROM documents), t AS (SELECT doc_id, lower(UNNEST(a)) AS w, generate_subscripts(a, 1) - 1 AS i FROM x),
n AS (SELECT *, LEAD(w) OVER (PARTITION BY doc_id ORDER BY i) AS w2 FROM t) SELECT doc_id, COUNT(*) FILTER (contains(w, 'the')) AS n, (COUNT(*) FILTER (ends_with(w, 's') AND starts_with(w2, 'a')))::BIGINT AS pairs FROM n GROUP BY doc_id HAVING COUNT(*) FILTER (contains(w, 'the')) + COUNT(*) FILTER (ends_with(w, 's') AND starts_with(w2, 'a')) > 0""")
def find_in_tokens(spark, d):
    """Occurrences as tokens: in one word (no token has two), or over the space between two."""
    t = _docs(spark, d).select("doc_id", F.posexplode(T.tokens("text", lower=False)).alias("tok_id", "token"))
    e = t.select("doc_id").distinct().withColumn("entity", F.explode(F.array(F.lit("THE"), F.lit("s a"))))
    found = K.find_in_tokens(t, e).groupBy("doc_id", "entity", "first", "last").agg(F.count("*").alias("c"))
    n = lambda x: F.sum((F.col("entity") == x).cast("long"))
    return found.groupBy("doc_id").agg(n("THE").alias("n"), n("s a").alias("pairs"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, (l_partkey % 90)::INT AS f, (l_partkey % 90 + l_quantity)::INT AS l FROM lineitem), t AS (SELECT i AS sent_id, i * 20 AS sf, i * 20 + 19 AS sl FROM range(0, 8) r(i)),
j AS (SELECT *, LEAST(l, sl) - GREATEST(f, sf) + 1 AS n FROM s JOIN t ON f <= sl AND sf <= l) SELECT sent_id, COUNT(*) AS n, SUM(GREATEST(f, sf) - sf)::BIGINT AS lf, SUM(LEAST(l, sl) - sf)::BIGINT AS ll FROM j WHERE 2 * n > l - f + 1 GROUP BY sent_id""")
def sentence_remap(spark, d):
    l = U.table(spark, d, "lineitem")  # noqa: E741
    s = l.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 90).cast("int").alias("first"), (F.col("l_partkey") % 90 + F.col("l_quantity")).cast("int").alias("last"))
    t = l.select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("sent_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))))
    t = t.withColumns({"s_first": F.col("sent_id") * 20, "s_last": F.col("sent_id") * 20 + 19})
    return K.sentence_remap(s, t).groupBy("sent_id").agg(F.count("*").alias("n"), F.sum("local_first").alias("lf"), F.sum("local_last").alias("ll"))


@query("""WITH n AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda x: x <> '')) - 1 AS m FROM documents), w AS (SELECT doc_id, m, UNNEST(range(0, greatest(ceil((m + 1 - 512) / 462.0), 0)::BIGINT + 1)) AS w FROM n WHERE m >= 0)
SELECT doc_id, COUNT(*) AS windows, SUM(LEAST(w * 462 + 511, m) - w * 462 + 1)::BIGINT AS tokens FROM w GROUP BY doc_id""")
def token_windows(spark, d):
    t = _docs(spark, d).select("doc_id", F.posexplode(T.tokens("text")).alias("tok_id", "token"))
    return K.windows(t).groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.col("w_last") - F.col("w_first") + 1).alias("tokens"))


@query()
def extract_spans(spark, d):
    s = P.extract_spans(_docs(spark, d), RULES)
    return P.resolve_overlaps(s).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


#: An original example pack: pattern, label, priority.
RULES = [(r"\b\d+([.,]\d+)?\s*%", "PERCENT", 9), (r"\b\d{4}-\d{2}-\d{2}\b", "DATE", 8), (r"\b\d+\b", "NUMBER", 2), (r"https?://\S+", "URL", 7), (r"\b[\w.+-]+@[\w-]+\.[\w.]+\b", "EMAIL", 7), (r"\b[A-Z][a-zà-ÿ]{6,}\b", "NAME", 1)]
LOOSE = [(r"\d+([.,]\d+)?", "NUMBER", 2), (r"https?://[^\s)]+", "URL", 7), (r"[\w.+-]+@[\w-]+\.\w+", "EMAIL", 7)]


@query()
def flagship_rule_evaluation(spark, d):
    """Extract spans with two rule packs, resolve overlaps, match one against the other, score every label and all."""
    one = P.resolve_overlaps(P.extract_spans(_docs(spark, d), RULES))
    two = P.resolve_overlaps(P.extract_spans(_docs(spark, d), LOOSE))
    return E.with_micro(M.match_overlap(one, two, "min", 0.8))


#: White space and word characters as tokenize's pattern has them.
BLANK, WORD = r"\s\x0b\x1c-\x1f\x{85}\p{Z}", r"\p{L}\p{N}_"


@query(f"""WITH x AS (SELECT ROW_NUMBER() OVER () AS r, doc_id, regexp_extract_all(text, '[{WORD}]+|[^{WORD}{BLANK}]|[{BLANK}]+') AS a FROM documents),
t AS (SELECT r, doc_id, UNNEST(a) AS token, generate_subscripts(a, 1) AS i FROM x),
o AS (SELECT doc_id, token, SUM(length(token)) OVER (PARTITION BY r ORDER BY i) AS e FROM t)
SELECT doc_id, COUNT(*) AS tokens, SUM(e - length(token))::BIGINT AS begins, SUM(e)::BIGINT AS ends FROM o WHERE NOT regexp_matches(token, '^[{BLANK}]') GROUP BY doc_id""")
def tokenize_offsets(spark, d):
    t = K.tokenize(_docs(spark, d))
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("begin").alias("begins"), F.sum("end").alias("ends"))


#: The tags of TAGS with every fourth event's taken out, under other names.
LOST = re.sub(r"\b(tags|numbered|started|bio)\b", r"p_\1", TAGS).replace("CASE event_type WHEN", "CASE CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type END WHEN")


@query(f"""WITH {TAGS}, {LOST}, b AS (SELECT doc_id, label, first, last, 1 AS g, 0 AS p FROM bio UNION ALL SELECT doc_id, label, first, last, 0, 1 FROM p_bio),
s AS (SELECT label, MAX(g) AS g, MAX(p) AS p FROM b GROUP BY doc_id, label, first, last), c AS (SELECT label, SUM(g * p)::BIGINT AS tp, SUM(p * (1 - g))::BIGINT AS fp, SUM(g * (1 - p))::BIGINT AS fn FROM s GROUP BY label) SELECT label, tp, fp, fn, {PRF} FROM c""")
def sequence_scores(spark, d):
    g = U.tags(spark, d).drop("score")
    p = g.withColumn("tag", F.when(F.col("event_id") % 4 == 0, "O").otherwise(F.col("tag")))
    return E.per_label(E.sequence_prf(g, p, ["doc_id"], ["ts", "event_id"]))


#: Words of documents between blanks with their places, and spans that begin inside, between or beyond them.
WORDS_SQL = """x AS (SELECT doc_id, list_filter(string_split_regex(text, '[^a-zA-Z0-9%]+'), lambda w: w <> '') AS a FROM documents), t AS (SELECT doc_id, UNNEST(a) AS token, generate_subscripts(a, 1) - 1 AS i FROM x),
o AS (SELECT doc_id, i, length(token) AS n, SUM(length(token) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS e FROM t), w AS (SELECT doc_id, i, e - n AS b, e FROM o),
s AS (SELECT doc_id, i AS k, CASE i % 30 WHEN 0 THEN b WHEN 10 THEN b + 1 ELSE e END AS b, CASE i % 30 WHEN 0 THEN e WHEN 10 THEN e + 4 ELSE e + 1 END AS e FROM w WHERE i % 10 = 0)"""


def _words_and_spans(spark, d) -> tuple[DataFrame, DataFrame]:
    t = K.offsets_of(_docs(spark, d).select("doc_id", F.posexplode(T.tokens("text", lower=False)).alias("tok_id", "token")))
    place = F.col("tok_id") % 30
    b = F.when(place == 0, F.col("begin")).when(place == 10, F.col("begin") + 1).otherwise(F.col("end"))
    e = F.when(place == 0, F.col("end")).when(place == 10, F.col("end") + 4).otherwise(F.col("end") + 1)
    return t, t.where("tok_id % 10 = 0").select("doc_id", F.col("tok_id").alias("k"), b.alias("begin"), e.alias("end"))


@query(f"""WITH {WORDS_SQL}, h AS (SELECT s.doc_id, k, w.i FROM s JOIN w ON w.doc_id = s.doc_id AND w.b <= s.b AND s.b < w.e), l AS (SELECT s.doc_id, k, w.i FROM s JOIN w ON w.doc_id = s.doc_id AND w.b < s.e AND s.e <= w.e)
SELECT doc_id, COUNT(*) AS n, COUNT(h.i + l.i) AS held, SUM(CASE WHEN l.i IS NOT NULL THEN h.i END)::BIGINT AS firsts, SUM(CASE WHEN h.i IS NOT NULL THEN l.i END)::BIGINT AS lasts FROM s LEFT JOIN h USING (doc_id, k) LEFT JOIN l USING (doc_id, k) GROUP BY doc_id""")
def token_containment(spark, d):
    """Character spans as the tokens that hold their first and last character."""
    s = K.to_token_span(*_words_and_spans(spark, d))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("first").alias("held"), F.sum("first").alias("firsts"), F.sum("last").alias("lasts"))


@query(f"""WITH {WORDS_SQL}, j AS (SELECT s.doc_id, k, MAX((w.b = s.b)::INT) AS at_b, MAX((w.e = s.e)::INT) AS at_e, MIN(w.i) FILTER (w.b <= s.b AND s.b < w.e) AS h, MAX(w.i) FILTER (w.b < s.e AND s.e <= w.e) AS l,
  MIN(w.i) FILTER (w.b >= s.b AND w.e <= s.e) AS i0, MAX(w.i) FILTER (w.b >= s.b AND w.e <= s.e) AS i1, MIN(w.i) FILTER (w.b < s.e AND s.b < w.e) AS m0, MAX(w.i) FILTER (w.b < s.e AND s.b < w.e) AS m1,
  arg_min(w.i, LEAST(abs(w.b - s.b), abs(w.e - s.e)) * 1000000 + w.i) AS near FROM s JOIN w USING (doc_id) WHERE w.i BETWEEN k - 40 AND k + 40 GROUP BY s.doc_id, k),
c AS (SELECT *, CASE WHEN at_b = 1 AND at_e = 1 THEN 'strict' WHEN h IS NOT NULL AND l IS NOT NULL THEN 'expand' WHEN i0 IS NOT NULL THEN 'contract' WHEN m0 IS NOT NULL THEN 'overlap' ELSE 'nearest' END AS how FROM j)
SELECT how, COUNT(*) AS n, SUM(CASE how WHEN 'strict' THEN h WHEN 'expand' THEN h WHEN 'contract' THEN i0 WHEN 'overlap' THEN m0 ELSE near END)::BIGINT AS firsts, SUM(CASE how WHEN 'strict' THEN l WHEN 'expand' THEN l WHEN 'contract' THEN i1 WHEN 'overlap' THEN m1 ELSE near END)::BIGINT AS lasts FROM c GROUP BY how""")
def token_cascade(spark, d):
    """Character spans as tokens by the cascade: strict, expand, contract, overlap, nearest."""
    s = K.to_token_span(*_words_and_spans(spark, d), cascade=True)
    return s.groupBy("how").agg(F.count("*").alias("n"), F.sum("first").alias("firsts"), F.sum("last").alias("lasts"))


@query("""WITH l AS (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, COUNT(*) AS sentences, SUM(len(list_filter(string_split(line, ' '), lambda x: x <> '')))::BIGINT AS tokens FROM l WHERE replace(line, ' ', '') <> '' GROUP BY doc_id""")
def sentence_breaks(spark, d):
    """Sentences that line breaks end, over tokens between blanks."""
    docs = _docs(spark, d)
    t = K.sentence_starts(K.tokenize(docs, pattern=r"[^ \n]+"), docs)
    return t.groupBy("doc_id").agg((F.max("sent_id") + 1).cast("long").alias("sentences"), F.count("*").alias("tokens"))


@query()
def token_spans(spark, d):
    """Tokens of documents under rule spans, as BIO tag counts."""
    return K.rule_tag_counts(_docs(spark, d), RULES)


# --- splits and tables -------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_returnflag AS label, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold FROM lineitem), t AS (SELECT COUNT(*) FILTER (fold = 'train') AS a, COUNT(*) FILTER (fold = 'test') AS b, COUNT(*) AS n FROM r), l AS (SELECT label, COUNT(*) FILTER (fold = 'train') AS a, COUNT(*) FILTER (fold = 'test') AS b FROM r GROUP BY label),
s AS (SELECT label, 100.0::DOUBLE * l.a / (l.a + l.b) AS pct_train, 100.0::DOUBLE * l.b / (l.a + l.b) AS pct_test, GREATEST(abs(100.0::DOUBLE * l.a / (l.a + l.b) - 100.0::DOUBLE * t.a / t.n), abs(100.0::DOUBLE * l.b / (l.a + l.b) - 100.0::DOUBLE * t.b / t.n), 0.0) AS diff FROM l, t)
SELECT label, pct_train, pct_test, diff, CASE WHEN diff < 2 THEN 'OK' WHEN diff < 5 THEN 'WARN' ELSE 'BAD' END AS status FROM s""")
def stratification_report(spark, d):
    l = U.table(spark, d, "lineitem")  # noqa: E741
    r = l.select(F.col("l_returnflag").alias("label"), F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("fold"))
    return E.stratification(r, ["train", "test"])


@query()
def stratified_split(spark, d):
    m = _docs(spark, d).select("doc_id", F.col("lang").alias("label"))
    return X.stratified_split(m, {"train": 0.8, "test": 0.2}, moves=50).groupBy("fold").agg(F.count("*").alias("n"))


def _doc_labels(spark, d) -> DataFrame:
    """Documents with their language, their source and whether they are long as labels; every ninth has none."""
    c = _docs(spark, d)
    labels = F.array("lang", "source", F.when(F.length("text") > 1000, "long"))
    return c.select("doc_id", F.explode(F.when(F.col("doc_id") % 9 == 0, F.array(F.lit(None).cast("string"))).otherwise(labels)).alias("label"))


@query("""WITH n AS (SELECT COUNT(*) AS n FROM documents), w AS (SELECT 'train' AS fold, 1 AS i, 0.7::DOUBLE AS w UNION ALL SELECT 'dev', 2, 0.1 UNION ALL SELECT 'test', 3, 0.2), f AS (SELECT fold, i, floor(n * w + 1e-9)::BIGINT AS low, n * w AS want, n FROM w, n),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY low - want, i) AS r, SUM(low) OVER () AS lows FROM f) SELECT fold, low + CASE WHEN r <= n - lows THEN 1 ELSE 0 END AS n, TRUE AS near FROM r""")
def label_set_split(spark, d):
    """Sizes of folds by label sets, and whether each fold has each label within one document of its share."""
    m, folds = _doc_labels(spark, d), {"train": 0.7, "dev": 0.1, "test": 0.2}
    s = X.split_by_label_sets(m, folds)
    share = F.create_map(*(F.lit(x) for kv in folds.items() for x in kv))
    got = m.where("label is not null").join(s, "doc_id").groupBy("label", "fold").agg(F.count("*").alias("c"))
    every = m.where("label is not null").groupBy("label").agg(F.count("*").alias("a"))
    near = got.join(every, "label").groupBy("fold").agg(F.min(F.abs(F.col("c") - F.col("a") * F.element_at(share, F.col("fold"))) <= 1 + 1e-9).alias("near"))
    return s.groupBy("fold").agg(F.count("*").alias("n")).join(near, "fold")


@query()
def hash_split(spark, d):
    return X.hash_split(_docs(spark, d), 0.2).groupBy("fold").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN r <= greatest(1, floor(0.1 * n)) THEN 'dev' ELSE 'train' END AS fold, COUNT(*) AS n FROM (SELECT ROW_NUMBER() OVER () AS r, COUNT(*) OVER () AS n FROM documents) GROUP BY ALL")
def exact_split(spark, d):
    return X.exact_split(_docs(spark, d), 0.1).groupBy("fold").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS dir, o_orderpriority AS name, o_totalprice AS f1 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def best_run(spark, d):
    b = E.best_by(U.table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice", ["o_orderkey"])
    return b.select(F.col("o_orderstatus").alias("dir"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("f1"))


@query("SELECT AVG(p_retailprice) AS mean, MAX(p_retailprice) AS greatest, (SELECT MIN(p_partkey) FROM part WHERE p_retailprice = (SELECT MAX(p_retailprice) FROM part)) AS greatest_name, MIN(p_retailprice) AS least, (SELECT MIN(p_partkey) FROM part WHERE p_retailprice = (SELECT MIN(p_retailprice) FROM part)) AS least_name, COUNT(*) AS n, COUNT(*) FILTER (p_retailprice > 0.7) AS n_above FROM part")
def metric_summary(spark, d):
    return E.summary(U.table(spark, d, "part"), "p_partkey", "p_retailprice").withColumn("mean", F.col("mean"))


@query("SELECT o_orderpriority AS dataset, MAX(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS \"O\", MAX(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS \"F\", MAX(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS \"P\" FROM orders GROUP BY ALL")
def compare_table(spark, d):
    s = U.table(spark, d, "orders").select(F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("name"), F.col("o_totalprice").alias("f1"))
    return E.compare_table(s, methods=["O", "F", "P"])


@query("SELECT o_custkey, MAX(o_totalprice) FILTER (o_orderstatus = 'O') AS train, MAX(o_totalprice) FILTER (o_orderstatus = 'F') AS test, MAX(o_totalprice) FILTER (o_orderstatus = 'O') - MAX(o_totalprice) FILTER (o_orderstatus = 'F') AS gap FROM orders GROUP BY o_custkey")
def train_test_gap(spark, d):
    s = U.table(spark, d, "orders").withColumn("fold", F.when(F.col("o_orderstatus") == "O", "train").when(F.col("o_orderstatus") == "F", "test"))
    return E.gap(s, ["o_custkey"], score="o_totalprice")


@query("SELECT COUNT(*) FILTER (g > 0 AND p = 0)::BIGINT AS n_empty, COUNT(*) AS n_docs FROM (SELECT l_orderkey, COUNT(*) AS g, COUNT(*) FILTER (l_linenumber % 5 <> 0 AND l_discount > 0.03) AS p FROM lineitem GROUP BY l_orderkey)")
def empty_predictions(spark, d):
    l = U.table(spark, d, "lineitem")  # noqa: E741
    n = l.groupBy("l_orderkey").agg(F.count("*").alias("n_gold"), F.sum(((F.col("l_linenumber") % 5 != 0) & (F.col("l_discount") > 0.03)).cast("long")).alias("n_pred"))
    return E.empty_predictions(n)


@query("SELECT l_orderkey AS doc_id, MAX((l_returnflag = 'A')::INT) AS \"A\", MAX((l_returnflag = 'N')::INT) AS \"N\", MAX((l_returnflag = 'R')::INT) AS \"R\" FROM lineitem GROUP BY l_orderkey")
def label_vectors(spark, d):
    return E.label_vector(U.gold(spark, d), ["A", "N", "R"])


@query("SELECT COUNT(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def incremental_skip(spark, d):
    return E.not_yet(_docs(spark, d), U.table(spark, d, "labels")).agg(F.count("*").alias("n"))


@query("SELECT model, layers FROM (VALUES ('m1'), ('m2'), ('m3')) a(model), (VALUES (0::BIGINT), (2::BIGINT)) b(layers)")
def parameter_grid(spark, d):
    return E.grid(spark, model=["m1", "m2", "m3"], layers=[0, 2])


@query("SELECT role || '-' || upper(left(text, 1)) AS tag, COUNT(*) AS n FROM conversations GROUP BY ALL")
def label_discovery(spark, d):
    c = U.table(spark, d, "conversations")
    return c.groupBy(F.concat_ws("-", "role", F.upper(F.substring("text", 1, 1))).alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS label, t AS threshold, COUNT(*) AS n FROM events, (VALUES (5.0::DOUBLE), (20.0::DOUBLE), (50.0::DOUBLE)) v(t) WHERE value >= t GROUP BY ALL")
def thresholds(spark, d):
    s = U.table(spark, d, "events").select(F.col("event_type").alias("label"), F.col("value").alias("score"))
    return predict.at_thresholds(s, [5.0, 20.0, 50.0]).groupBy("label", "threshold").agg(F.count("*").alias("n"))


# --- formats: every document as an annotation file in memory ------------------------------------------------------


def _ann(spark, d) -> DataFrame:
    """Stand-off lines made of line items: a span, its attribute, and a relation."""
    l = U.table(spark, d, "lineitem")  # noqa: E741
    n, b = F.col("l_linenumber"), (F.col("l_partkey") % 500)
    span = F.format_string("T%d\t%s %d %d;%d %d\tpart %d", n, F.col("l_returnflag"), b, b + 5, b + 9, b + 9 + F.col("l_quantity").cast("long"), "l_partkey")
    attr = F.format_string("A%d\tNegated T%d %s", n, n, F.when(F.col("l_linestatus") == "F", "true").otherwise("false"))
    rel = F.format_string("R%d\tNEXT Arg1:T%d Arg2:T%d", n, n, n + 1)
    return l.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(span, attr, rel)).alias("line")).withColumn("line_no", F.lit(0))


@query("SELECT l_returnflag AS label, COUNT(*) AS n, SUM(l_partkey % 500)::BIGINT AS b, SUM(l_partkey % 500 + 9 + l_quantity::BIGINT)::BIGINT AS e FROM lineitem GROUP BY ALL")
def brat_envelope(spark, d):
    s = brat.parse_spans(_ann(spark, d), "envelope")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum("begin").alias("b"), F.sum("end").alias("e"))


@query("SELECT l_returnflag AS label, 2 * COUNT(*) AS n, SUM(2 * (l_partkey % 500) + 9)::BIGINT AS b, SUM(2 * (l_partkey % 500) + 14 + l_quantity::BIGINT)::BIGINT AS e FROM lineitem GROUP BY ALL")
def brat_fragments(spark, d):
    s = brat.parse_spans(_ann(spark, d), "all_fragments")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum("begin").alias("b"), F.sum("end").alias("e"))


@query("SELECT l_returnflag AS label, COUNT(*) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_partkey % 500 AS b FROM lineitem) GROUP BY ALL")
def brat_first_fragment_set(spark, d):
    return brat.span_set(brat.parse_spans(_ann(spark, d), "first_fragment")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS label, COUNT(DISTINCT l_partkey) AS n_values FROM lineitem GROUP BY ALL")
def brat_values(spark, d):
    return brat.parse_spans(_ann(spark, d), "ignore_offsets").groupBy("label").agg(F.countDistinct("text").alias("n_values"))


@query("SELECT k AS key, COUNT(*) AS n FROM (SELECT UNNEST([l_returnflag, 'Negated', 'Negated:' || CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'false' END, 'Relation_NEXT']) AS k FROM lineitem) GROUP BY k")
def brat_kind_counts(spark, d):
    return brat.kind_counts(_ann(spark, d))


@query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS c FROM lineitem), u AS (SELECT o, n, f, MAX(s = 'F') OVER (PARTITION BY o, n) AS neg FROM t)
SELECT f AS label, COUNT(*) AS n, COUNT(*) FILTER (neg) AS negated FROM u GROUP BY f""")
def brat_negation(spark, d):
    l = _ann(spark, d)
    s = P.attach_attribute(brat.parse_spans(l), brat.parse_attributes(l), "Negated", "negated")
    return s.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("negated").cast("long")).alias("negated"))


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS f FROM lineitem) SELECT a.f AS head, b.f AS tail, COUNT(*) AS n FROM l r JOIN l a ON a.o = r.o AND a.n = r.n JOIN l b ON b.o = r.o AND b.n = r.n + 1 GROUP BY ALL""")
def brat_relations(spark, d):
    l = _ann(spark, d)
    r = P.resolve_relations(brat.parse_relations(l), brat.parse_spans(l))
    return r.groupBy(F.col("head.label").alias("head"), F.col("tail.label").alias("tail")).agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS fold FROM lineitem), u AS (SELECT *, MAX(s = 'F') OVER (PARTITION BY o, n) AS neg FROM l),
c AS (SELECT fold, 'label' AS kind, f AS key FROM u UNION ALL SELECT fold, 'negated', f FROM u WHERE neg UNION ALL SELECT fold, 'relation', 'NEXT' FROM u) SELECT fold, kind, key, COUNT(*) AS n FROM c GROUP BY ALL""")
def split_counts(spark, d):
    """Labels, negated labels and relations of each fold."""
    l = _ann(spark, d)
    s = P.attach_attribute(brat.parse_spans(l), brat.parse_attributes(l), "Negated", "negated")
    fold = U.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train").alias("fold"))
    return E.split_counts(s, fold, brat.parse_relations(l))


@query("""SELECT lang AS label, COUNT(*) AS n, SUM(doc_id % 50)::BIGINT AS b, SUM(doc_id % 50 + doc_id % 7 + 1)::BIGINT AS e FROM documents WHERE doc_id % 9 <> 0 GROUP BY lang""")
def brat_source(spark, d):
    """Documents' spans written as stand-off files in a shared folder, and read again; every ninth document's file is empty."""
    docs = _docs(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("label"), (F.col("doc_id") % 50).cast("int").alias("begin"), (F.col("doc_id") % 50 + F.col("doc_id") % 7 + 1).cast("int").alias("end"))
    spans = docs.where("doc_id % 9 <> 0").withColumn("text", F.col("label"))
    folder = shared.scratch_folder(spark, "brat")
    sinks.write_documents(sinks.brat_text(spans, documents=docs), folder)
    return standoff.read_spans(spark, folder).groupBy("label").agg(F.count("*").alias("n"), F.sum("begin").alias("b"), F.sum("end").alias("e"))


@query("""SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::BIGINT AS words FROM documents""")
def ledger_resume(spark, d):
    """Words of documents by a run that is taken up again: first the half of the documents, some with other texts, then all."""
    docs = _docs(spark, d).select("doc_id", "text")
    work = lambda x: x.select("doc_id", T.word_count("text").alias("words"))
    folder = shared.scratch_folder(spark, "ledger")
    half = docs.where("doc_id % 2 = 0").withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    ledger.resume(half, work, folder)
    return ledger.resume(docs, work, folder, batches=2)


@query("""SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def first_rows(spark, d):
    return E.first_rows(U.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 25)


@query(f"""WITH {GOLD}, n AS (SELECT doc_id, 'T' || ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY b, e, label) || chr(9) || label || ' ' || b || ' ' || e || chr(9) || label AS l, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY b, e, label) AS i FROM gold),
c AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) || chr(10) AS c FROM n GROUP BY doc_id) SELECT doc_id, length(c) AS n_chars, sha256(c) AS sha256 FROM c""")
def brat_writer(spark, d):
    s = U.gold(spark, d).withColumn("text", F.col("label"))
    return sinks.brat_text(s).select("doc_id", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("sha256"))


@query("SELECT lang, SUM(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')))::BIGINT AS tokens FROM documents GROUP BY lang")
def conll_tokens(spark, d):
    """Documents read as one token a line."""
    docs = _docs(spark, d)
    t = formats.parse_conll(docs.select("doc_id", "text"))
    return t.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("tokens"))


@query(f"""WITH {TAGS} SELECT doc_id, sha256(string_agg('e' || event_id || ' ' || tag, chr(10) ORDER BY event_id) || chr(10) || chr(10)) AS sha256 FROM tags GROUP BY doc_id""")
def conll_writer(spark, d):
    t = U.tags(spark, d)
    t = t.select(F.col("doc_id"), F.lit(0).alias("sent_id"), F.col("event_id").alias("tok_id"), F.format_string("e%d", "event_id").alias("token"), "tag")
    return sinks.conll_text(t).select("doc_id", F.sha2("content", 256).alias("sha256"))


@query()
def sample_json(spark, d):
    """Training samples of documents: their tokens, and rule spans as tokens."""
    return sinks.json_of_samples(K.rule_samples(_docs(spark, d), RULES)).select("doc_id", F.sha2("json", 256).alias("sha256"))
