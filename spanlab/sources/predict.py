"""Models as sources of spans: any callable, loaded once a task, called in batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions.text import json_entities
from spanlab.operators import tokens as K


class Predictor(Protocol):
    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """For each text its spans: begin, end, label, score."""


def predict_spans(docs: DataFrame, load: Callable[[], Predictor], min_score: float = 0.0, text_col: str = "text", keep: list[str] = ["doc_id"], batch: int = 32) -> DataFrame:  # noqa: B006
    """keep, begin, end, label, score.  Null text has no spans."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                rows = [(i, *s) for i, spans in enumerate(model([t or "" for t in part[text_col]])) for s in spans if s[3] >= min_score]
                out = pd.DataFrame(rows, columns=["__i", "begin", "end", "label", "score"])
                yield pd.concat([part[keep].reset_index(drop=True).loc[out.pop("__i")].reset_index(drop=True), out], axis=1)

    d = docs.select(*keep, text_col)
    return d.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in d.select(*keep).dtypes) + ", begin int, end int, label string, score double")


class Tagger(Protocol):
    def __call__(self, sentences: list[list[str]]) -> list[list[tuple[int, str, float]]]:
        """For each sentence's words their pieces in order: index of the word, BIO tag, score.  A word may have several, or none."""


def predict_tags(docs: DataFrame, load: Callable[[], Tagger], text_col: str = "text", keep: list[str] = ["doc_id"], batch: int = 32) -> DataFrame:  # noqa: B006
    """keep, begin, end, label, n, score: words of a line are a sentence; a word has the tag of its first piece; tags make spans of characters.

    The model is loaded once a task and called with ``batch`` sentences; words without a piece are O.  Ids must be
    unique.  Null and empty texts have no spans.
    """
    words = K.sentence_starts(K.tokenize(docs, text_col, keep), docs, keep, text_col)
    by = [*keep, "sent_id"]
    words = words.withColumn("tok_id", F.row_number().over(Window.partitionBy(*by).orderBy("tok_id")) - 1)  # in the sentence
    lines = words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("tok_id", "token"))).alias("w"))
    lines = lines.select(*by, F.transform("w", lambda x: x["tok_id"]).alias("ids"), F.transform("w", lambda x: x["token"]).alias("words"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch].reset_index(drop=True)
                rows = []
                for i, pieces in enumerate(model([list(w) for w in part.words])):
                    first: dict[int, tuple] = {}
                    for word, tag, score in pieces:
                        first.setdefault(word, (tag, score))
                    rows += [(i, int(part.ids[i][word]), tag, float(score)) for word, (tag, score) in first.items()]
                out = pd.DataFrame(rows, columns=["__i", "tok_id", "tag", "score"])
                yield pd.concat([part[by].loc[out.pop("__i")].reset_index(drop=True), out], axis=1)

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    tags = lines.mapInPandas(run, f"{kinds}, sent_id int, tok_id int, tag string, score double")
    told = words.join(tags, [*by, "tok_id"], "left").withColumns({"tag": F.coalesce("tag", F.lit("O")), "score": F.coalesce("score", F.lit(0.0))})
    spans = K.bio_spans(told, by)
    return K.to_char_span(spans, words.select(*by, "tok_id", "begin", "end"), by).drop("sent_id", "first", "last")


def at_thresholds(spans: DataFrame, thresholds: list[float]) -> DataFrame:
    """spans once for each threshold that their score reaches."""
    t = F.filter(F.array(*(F.lit(float(x)) for x in thresholds)), lambda x: F.col("score") >= x)
    return spans.withColumn("threshold", F.explode(t))


def query_responses(docs: DataFrame, load: Callable[[], Callable[[str], str]], prompt: Callable[[str], str] = str, tries: int = 5, back_off: float = 5.0, text_col: str = "text", keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """keep, response.  A query that fails is tried again after back_off * attempt seconds; after the last try the response is []."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = load()

        def one(text) -> str:
            for k in range(1, tries + 1):
                try:
                    return ask(prompt(text or ""))
                except Exception:  # noqa: BLE001 - any failure of a remote model
                    if k < tries:
                        time.sleep(back_off * k)
            return "[]"

        for f in frames:
            yield f[keep].assign(response=[one(t) for t in f[text_col]])

    d = docs.select(*keep, text_col)
    return d.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in d.select(*keep).dtypes) + ", response string")


def response_entities(responses: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Entities named in responses, a row each: all columns but response, with entity and label."""
    e = responses.withColumn("__e", F.explode(json_entities("response", labels)))
    return e.withColumns({"entity": F.col("__e.text"), "label": F.col("__e.label")}).drop("__e", "response")
