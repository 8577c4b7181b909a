"""Table functions for SQL users: SELECT ... FROM docs d, LATERAL extract_spans(d.text, '[0-9]+', 'NUMBER') s."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_compiled = lru_cache(maxsize=256)(re.compile)


class ExtractSpans:
    """(text, pattern, label) -> begin, end, label, text of every match that is not empty; null text or pattern has none."""

    def eval(self, text, pattern, label):
        if text is not None and pattern is not None:
            for m in _compiled(pattern).finditer(text):
                if m.end() > m.start():
                    yield m.start(), m.end(), label, m.group()


class FindOccurrences:
    """(text, entity) -> begin, end of every occurrence in any case, overlapping ones too; as operators.spans.find_occurrences."""

    def eval(self, text, entity):
        from spanlab.operators.spans import folded

        if text and entity:
            low, ent = folded(text), folded(entity)
            i = low.find(ent)
            while i >= 0:
                yield i, i + len(entity)
                i = low.find(ent, i + 1)


def register(spark: SparkSession) -> None:
    """Make extract_spans and find_occurrences known to spark.sql."""
    spark.udtf.register("extract_spans", udtf(ExtractSpans, returnType="begin: int, end: int, label: string, text: string"))
    spark.udtf.register("find_occurrences", udtf(FindOccurrences, returnType="begin: int, end: int"))
