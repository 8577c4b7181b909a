"""The registered queries opN_<name> of the corpus operators, with production parameters, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm import automaton, bpe, embed, lines, minhash, negatives, packing, quality, secret_scan, shards, spelling, suffix, winnow
from spanlab.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def fitted_quality(spark: SparkSession, sf_dir: str) -> quality.Evidence:
    return quality.fit_evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: evidence, the posterior means of its source and of its (source, language), quality, keep."""
    scored = quality.score_documents(table(spark, sf_dir, "documents"), fitted_quality(spark, sf_dir), "source", "lang")
    return scored.select("doc_id", "evidence", "host_mean", "path_mean", "quality", "keep")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_digests(table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = minhash.near_documents(table(spark, sf_dir, "documents"), size=4, percent=80)
    return near.select(near.d.alias("doc_id"), "n_shingles", "component_id", "kept")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"), min_docs=10)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan_documents(table(spark, sf_dir, "documents")))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.passage_digests(table(spark, sf_dir, "documents"), size=200)


def op8_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.passage_digests(table(spark, sf_dir, "documents"), size=13)


def word_ids():
    return packing.word_encoder(WORDS).encode


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_ids, end_id=2)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_vectors(table(spark, sf_dir, "embeddings"), min_cosine=0.93)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row's label is a wrong one, so that hard negatives include mislabelled rows."""
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(v.withColumn("label", label), F.col("vec_id") % 100 == 0)


def misspelt_words(docs: DataFrame, least: int = 7) -> DataFrame:
    """One row (word) per run of letters of ``least`` code points or more, A-Z lower-cased; a checksum of document and run picks runs that lose a letter."""
    runs = F.filter(F.split("text", "[^A-Za-z\u00C0-\u00FF]+"), lambda x: F.length(x) >= least)
    w = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(runs).alias("run"))
    w = w.withColumn("run", lines.ascii_lower(F.col("run"))).withColumn("h", F.crc32(F.concat_ws(":", "i", "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return w.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(misspelt_words(table(spark, sf_dir, "documents")), min_chars=7, min_count=2, ratio=10)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = shards.shard_documents(docs, 24, "bytes", keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict:
    ops = (op1_byte_bpe, op2_quality, op3_winnowing, op4_minhash, op5_line_dedup, op6_secret_scan, op7_suffix_array, op8_suffix_automaton, op9_packing, op10_embedding_dedup, op11_hard_negatives, op12_spelling, op13_sharding)
    return {f.__name__: f for f in ops}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS_OF = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP4_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS_OF.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS s FROM w),
e AS (SELECT doc_id, UNNEST(s) AS g FROM s), p AS (SELECT a.doc_id AS u, b.doc_id AS v, COUNT(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v WHERE 100 * n >= 80 * (len(a.s) + len(b.s) - n)), b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r(n, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.n), m AS (SELECT n AS doc_id, MIN(c) AS component_id FROM r GROUP BY n)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)"""

OP5_SQL = f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), l AS (SELECT doc_id, UNNEST(a) AS line, generate_subscripts(a, 1) AS pos FROM s),
k AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS key FROM l), hot AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot USING (key))
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

OP8_SQL = f"""WITH w AS (SELECT doc_id, {WORDS_OF.format("coalesce(text, '')")} AS w FROM documents), t AS (SELECT doc_id, UNNEST(w) AS word, generate_subscripts(w, 1) AS i FROM w),
x AS (SELECT doc_id, UNNEST(range(1, greatest(len(w) - 11, 1))) AS i, w FROM w), y AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM x), f AS (SELECT g, MIN(doc_id) AS d FROM y GROUP BY g),
c AS (SELECT DISTINCT doc_id, i + UNNEST(range(13)) AS i FROM y JOIN f USING (g) WHERE d < doc_id), m AS (SELECT t.*, c.i IS NOT NULL AS gone FROM t LEFT JOIN c USING (doc_id, i)),
n AS (SELECT doc_id, COUNT(*) AS n_words, COUNT(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN n USING (doc_id)"""

OP10_SQL = """WITH RECURSIVE g AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
b AS (SELECT a.vec_id AS u, c.vec_id AS v FROM g a JOIN g c ON a.label = c.label AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE list_cosine_similarity(a.v, c.v) >= 0.93),
r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.n), m AS (SELECT n AS vec_id, MIN(c) AS component_id FROM r GROUP BY n), k AS (SELECT u AS vec_id, COUNT(*) AS n FROM b GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN k USING (vec_id)"""


OP11_SQL = """WITH g AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM g a JOIN g b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, ROW_NUMBER() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """Twins of the queries that SQL expresses; the others are held against brute force, round trips and held-out labels in tests/llm."""
    return {"op4_minhash": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_suffix_automaton": OP8_SQL, "op10_embedding_dedup": OP10_SQL, "op11_hard_negatives": OP11_SQL}
