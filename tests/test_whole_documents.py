"""Work on whole documents, of which only the texts are shuffled, against the operators over tokens and spans."""

import random
import re

import pytest

from spanlab.operators import spans as P
from spanlab.operators import tokens as K
from spanlab.plans import catalog
from spanlab.sources import sinks

RULES = [*catalog.RULES, ("[a-c]{2,5}", "PART", 3), (r"\s*-\s*", "GAP", 4), (r"[.;]?", "GAP", 4), ("d e", None, 5)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    signs = ["a", "b", "c", "d", "e", "d e", "Abcdefgh", "7", "12.5 %", "2024-01-31", "x@y.z", "http://a.b", " ", "\n", "\t", "\x1c", "\x85", " ", "\x00", "\x7f", "-", " - ", "_", ".", '"', "\\", "é", "日本", "😀", "́", "½"]
    texts = {i: "".join(rng.choices(signs, k=rng.choice((1, 5, 60, 400)))) for i in range(60)}
    texts |= {70: "", 71: None, 72: " \n\x1c", 73: " - \n", 74: "no rule", 75: "Abcdefgh " * 3000}
    twice = [(80, "abc - Abcdefgh 12 %")] * 2
    return spark.createDataFrame([*texts.items(), *twice, (None, "abc 12"), (None, "Abcdefgh")], "doc_id long, text string").repartition(5)


def test_samples(spark, docs):
    t = K.tokenize(docs)
    want = sinks.sample_json(t, K.to_token_span(t, P.resolve_overlaps(P.extract_spans(docs, RULES)), cascade=True))
    got = sinks.json_of_samples(K.rule_samples(docs, RULES))
    assert got.dtypes == want.dtypes and rows(got) == rows(want) and len(rows(got)) > 60
    assert rows(sinks.json_of_samples(K.rule_samples(docs, []))) == rows(sinks.sample_json(t, K.to_token_span(t, P.extract_spans(docs, []), cascade=True)))
    pair = [(1, "b 12"), (1, "a Abcdefgh 1")]
    one, other = (rows(K.rule_samples(spark.createDataFrame(x, "doc_id long, text string"), RULES)) for x in (pair, pair[::-1]))
    assert one == other and [x[1] for x in one] == [["a", "b", "12", "Abcdefgh", "1"]]


def test_samples_shuffle_texts_only(spark):
    assert exchanges(catalog.queries()["sample_json"](spark, "/root/testdata/sf0.001")) == 1


def test_tag_counts(spark, docs):
    tags = lambda rules: K.bio_tags_longest(K.tokenize(docs), P.resolve_overlaps(P.extract_spans(docs, rules))).groupBy("tag").count()
    got = K.rule_tag_counts(docs, RULES)
    assert got.dtypes == [("tag", "string"), ("n", "bigint")] and rows(got) == rows(tags(RULES)) and len(rows(got)) > 8
    assert rows(K.rule_tag_counts(docs, [])) == rows(tags([])) and K.rule_tag_counts(docs.where("false"), RULES).count() == 0
    assert rows(K.rule_tag_counts(docs, [("abc", "PART", 1), ("d e", "PART", 2)])) == rows(tags([("abc", "PART", 1), ("d e", "PART", 2)]))


def test_tag_counts_shuffle_texts_only(spark):
    assert exchanges(catalog.queries()["token_spans"](spark, "/root/testdata/sf0.001")) == 2  # texts, and a row a tag and task


@pytest.mark.parametrize("batch", [1, 7, 100_000])
def test_long_texts_are_cut_in_parts(monkeypatch, batch):
    """Tokens of a text come in parts that are cut before a character of no word, and are those of one walk."""
    monkeypatch.setattr(K, "BATCH", batch)
    for text in ("ab, c\n\n d" * 50, "...." * 20, "x" * 300, "日本 \x1c\x85😀!" * 9, " \n", "a"):
        parts = [*K._cut(text, *K._cutter())]
        assert [(int(b), int(e), w) for x in parts for b, e, w in zip(*x)] == [(*m.span(), m[0]) for m in re.finditer(K.PATTERN, text)]
        assert len(parts) <= len(text) // batch + 1
        assert " " not in text or max(len(w) for *_, w in parts) <= batch + 1
