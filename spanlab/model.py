"""Schemas and vocabularies of the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass, field

SPANS = "corpus string, method string, doc_id string, label string, begin int, end int, text string, priority int, score double"
DOCUMENTS = "doc_id string, corpus string, text string"
RULES = "pattern string, label string, priority int, flags string"
SAMPLE = "tokenized_text array<string>, ner array<array<string>>, relations array<struct<type:string,head:array<string>,tail:array<string>>>, _source string"
SCORES = "doc_id string, label string, tp bigint, fp bigint, fn bigint"
#: Methods from the cheapest to the dearest.
FRUGAL = ("rules", "TBM", "LLM")


@dataclass(frozen=True)
class CorpusConfig:
    """One corpus: where its parts are, which labels count, how spans are read and matched."""

    name: str
    gold_dir: str
    text_dir: str | None = None
    pred_dirs: dict[str, str] = field(default_factory=dict)
    labels: tuple[str, ...] = ()
    discontinuous: str = "envelope"
    metric: str = "exact"
    threshold: float = 0.8
    keep_crlf: bool = False
    strip_text: bool = False
