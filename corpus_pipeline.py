"""From raw documents to packed training sequences: five stages, each of one corpus operator.

    run(spark, sf_dir)  quality classifier -> line dedup -> MinHash near-dedup -> secret scans -> packing

Every stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlab.llm import lines, minhash, packing, quality, secret_scan
from spanlab.llm.common import discard, materialize, scratch, table
from spanlab.llm.queries import word_ids


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the labelled ones."""
    model = quality.fit_evidence(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model, "source", "lang")
    return scored.where(F.col("keep")).select(*(f"`{c}`" for c in docs.columns))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share are dropped from all of them; no document is."""
    return lines.dedup_lines(docs, min_docs=10)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 on five-word shingles."""
    return minhash.drop_near_documents(docs, size=5, percent=80)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; no document is dropped."""
    return secret_scan.redact_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens, as op9 returns them."""
    return packing.pack_documents(docs, word_ids, end_id=2)


STAGES = [
    ("quality", good_documents),
    ("line_dedup", without_common_lines),
    ("near_dedup", without_near_copies),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # a stage's own tables go when its documents are written, and so do the documents it read
            docs = materialize(stage(spark, docs, sf_dir))
            keep(docs)
        if read is not None:
            discard(read)
        read = docs
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
