"""Span operators over streams of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.operators.spans import extract_spans


def stream_spans(docs: DataFrame, rules: list[tuple]) -> DataFrame:
    """Spans of each document as it comes; stateless, so the batch operator runs unchanged."""
    return extract_spans(docs, rules)


def stream_label_counts(spans: DataFrame, time_col: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Label counts in tumbling windows; rows later than ``late`` behind the watermark are dropped."""
    return spans.withWatermark(time_col, late).groupBy(F.window(time_col, window), "label").agg(F.count("*").alias("n"))


def in_batches(docs: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """each(batch, id) for every micro-batch: for operators that need a document's rows together, such as resolve_overlaps."""
    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
