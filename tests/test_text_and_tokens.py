import pytest
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import metrics as C
from spanlab.operators import routing as R
from spanlab.operators import tokens as K
from spanlab.sources import formats, predict, sinks


def one(spark, col, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(col.alias("x")).first().x


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_text(spark):
    assert one(spark, T.shape("t"), t="AB2 3+") == "XXD D+"
    assert one(spark, T.shape("t", compat=True), t="AB2 3+") == "XXX X+"
    assert one(spark, T.tokens("t"), t="Ki67 é10%") == ["ki67", "10%"]
    assert one(spark, T.word_count("t"), t=" a b  c\n") == 3
    assert one(spark, T.normalized("t"), t=" É  À ") == "e a"
    assert one(spark, T.snippet("t", F.lit(2), F.lit(3), 2), t="a\nbcde") == "a bcd"
    assert one(spark, F.size(T.json_entities("t")), t='noise [{"text":"x","label":"L"},{"label":"L"}] end') == 1
    assert one(spark, F.size(T.json_entities("t")), t="[oops") == 0
    assert one(spark, T.stars(F.lit(0.01)), t="") == "**"
    assert one(spark, T.sigmoid(F.lit(0.5)), t="") == 0.5
    assert one(spark, T.fit_diagnosis(F.lit(1.0), F.lit(0.5), F.lit(0.4)), t="") == "OVER"


def test_homogeneity_and_risk(spark):
    m = spark.createDataFrame([("L", "a a a b")], "label string, value string")
    r = C.homogeneity(m).first()
    assert (r.he, r.he_score) == (0.5, 0.5)
    v = spark.createDataFrame([("ER", "10%"), ("ER", "er 10%"), ("HER2_status", "Score 3"), ("Stage", "pT2N0")], "label string, value string")
    got = {r.value: (r.at_risk, r.explicit, r.structured) for r in C.risk_flags(v).collect()}
    assert got == {"10%": (True, False, False), "er 10%": (False, True, False), "Score 3": (True, False, False), "pT2N0": (False, False, True)}


@pytest.mark.parametrize("te, he, r, freq, n, method", [(0.8, 0.7, 0.1, 0.0, 0, "rules"), (0.3, 0, 1.0, 0.01, 60, "light ML"), (0.3, 0, 1.0, 0.01, 50, "transformer"), (0.1, 0, 0.9, 0.0, 0, "LLM"), (0.2, 0, 0.9, 0.0, 0, "rules (default)")])
def test_tree(spark, te, he, r, freq, n, method):
    d = spark.createDataFrame([("x", te, float(he), r, freq, n)], "label string, te double, he double, r double, freq double, count long")
    assert R.decision_tree(d).first().method == method


def test_bio(spark):
    t = spark.createDataFrame([("d", i, x) for i, x in enumerate("O B-X I-X I-Y O I-X B-X".split())], "doc_id string, tok_id int, tag string")
    assert rows(K.bio_spans(t), "first", "last", "label") == [(1, 2, "X"), (3, 3, "Y"), (5, 5, "X"), (6, 6, "X")]
    tok = spark.createDataFrame([("d", i) for i in range(3)], "doc_id string, tok_id int")
    s = spark.createDataFrame([("d", 0, 1, "X", 0), ("d", 1, 2, "Y", 1), ("d", 2, 5, "Z", 2)], "doc_id string, first int, last int, label string, ord int")
    assert [x[1] for x in rows(K.bio_tags(tok, s), "tok_id", "tag")] == ["B-X", "B-Y", "I-Y"]


def test_tokens_and_spans(spark):
    d = spark.createDataFrame([("d", "Ab, cé\n12 x")], "doc_id string, text string")
    t = K.tokenize(d)
    assert rows(t, "begin", "end", "token") == [(0, 2, "Ab"), (2, 3, ","), (4, 6, "cé"), (7, 9, "12"), (10, 11, "x")]
    assert [x[1] for x in rows(K.sentence_starts(t, d), "tok_id", "sent_id")] == [0, 0, 0, 1, 1]
    s = spark.createDataFrame([("d", 0, 6), ("d", 1, 9), ("d", 3, 4)], "doc_id string, begin int, end int")
    assert rows(K.to_token_span(t, s), "begin", "first", "last")[:2] == [(0, 0, 2), (1, 0, 3)]
    how = {r.begin: (r.how, r.first, r.last) for r in K.to_token_span(t, s, cascade=True).collect()}
    assert how == {0: ("strict", 0, 2), 1: ("expand", 0, 3), 3: ("nearest", 1, 1)}
    char = K.to_char_span(spark.createDataFrame([("d", 0, 2)], "doc_id string, first int, last int"), t)
    assert rows(char, "begin", "end") == [(0, 6)]
    sp = spark.createDataFrame([("d", "L", 0, 6), ("d", "M", 4, 9)], "doc_id string, label string, begin int, end int")
    assert [x[1] for x in rows(K.bio_tags_longest(t, sp), "tok_id", "tag")] == ["B-L", "I-L", "I-L", "O", "O"]


def test_offsets_shuffle_lengths(spark):
    """Where no token is asked for, none is dealt by document; a null token has no begin and takes no place."""
    words = spark.createDataFrame([("d", 0, "ab"), ("d", 1, None), ("d", 2, "c")], "doc_id string, tok_id int, token string")
    o = K.offsets_of(words)
    assert rows(o, "tok_id", "begin", "end") == [(0, 0, 2), (1, None, 2), (2, 3, 4)]
    plan = o.select("doc_id", "tok_id", "begin", "end")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not [x for x in plan.splitlines() if "Project [" in x and ", token#" in x]


def test_sentences_are_dealt_by_their_own_size(spark):
    """Sentences that were multiplied after their documents had been dealt are dealt anew; null keys stay out."""
    s = spark.range(40).selectExpr("if(id % 9 = 0, null, id % 7) AS doc_id", "cast(id AS int) AS first", "cast(id + 3 AS int) AS last")
    t = s.select("doc_id").distinct().withColumn("sent_id", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumns({"s_first": F.col("sent_id") * 6, "s_last": F.col("sent_id") * 6 + 5})
    got = K.sentence_remap(s, t.hint("merge"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(__h") == 2 and plan.count("Exchange hashpartitioning") == 3
    want = sorted((i % 7, i, k, max(i, 6 * k) - 6 * k, min(i + 3, 6 * k + 5) - 6 * k) for i in range(40) if i % 9 for k in range(8) if 2 * (min(i + 3, 6 * k + 5) - max(i, 6 * k) + 1) > 4)
    assert sorted(tuple(r) for r in got.select("doc_id", "first", "sent_id", "local_first", "local_last").collect()) == want


def test_sentence_remap(spark):
    s = spark.createDataFrame([("d", 3, 6), ("d", 3, 5), ("d", 6, 8)], "doc_id string, first int, last int")
    t = spark.createDataFrame([("d", 0, 0, 4), ("d", 1, 5, 9)], "doc_id string, sent_id int, s_first int, s_last int")
    assert rows(K.sentence_remap(s, t), "sent_id", "local_first", "local_last") == [(0, 3, 4), (1, 1, 3)]


def test_windows(spark):
    t = spark.createDataFrame([("d", i) for i in range(12)], "doc_id string, tok_id int")
    assert rows(K.windows(t, 5, 2), "w_first", "w_last") == [(0, 4), (3, 7), (6, 10), (9, 11)]


def test_formats(spark, tmp_path):
    d = spark.createDataFrame([("d", "a O\nb x B-L\n\n\nc I-L\n")], "doc_id string, text string")
    assert rows(formats.parse_conll(d), "sent_id", "tok_id", "token", "tag") == [(0, 0, "a", "O"), (0, 1, "b", "B-L"), (1, 0, "c", "I-L")]
    out = sinks.conll_text(formats.parse_conll(d)).first().content
    assert out == "a O\nb B-L\n\nc I-L\n\n"
    (tmp_path / "p.json").write_text('{"d1": [[0, 3, "A"]], "d2": []}')
    assert rows(formats.read_prediction_cache(spark, str(tmp_path / "p.json")), "doc_id", "begin", "end", "label") == [("d1", 0, 3, "A")]
    assert formats.optional(formats.read_score_cache, spark, str(tmp_path / "absent.json")) is None
    s = spark.createDataFrame([("d", "B", 4, 6, "x\ny", "a b"), ("d", "A", 0, 3, "abc", None)], "doc_id string, label string, begin int, end int, text string, value string")
    assert sinks.brat_text(s).first().content == "T1\tA 0 3\tabc\nT2\tB 4 6\tx y\n"
    assert sinks.brat_text(s, values=True).first().content == "T1\tA 0 3\tabc\nT2\tB 4 6\tx y\nA2\tValue T2 a_b"


def test_predictors(spark):
    d = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    p = predict.predict_spans(d, lambda: lambda texts: [[(0, len(t), "L", 0.5)] if t else [] for t in texts])
    assert rows(p, "doc_id", "begin", "end", "label") == [(1, 0, 2, "L")]
    assert rows(predict.at_thresholds(p, [0.3, 0.5, 0.6]), "threshold") == [(0.3,), (0.5,)]

    def broken():
        def ask(prompt):
            raise OSError

        return ask

    r = predict.query_responses(d, broken, tries=2, back_off=0.0)
    assert {x.response for x in r.collect()} == {"[]"}


def test_windows_merge(spark):
    t = spark.createDataFrame([(1, 0, 0, "B-X", 0.9), (1, 0, 1, "I-X", 0.4), (1, 1, 1, "B-Y", 0.8), (1, 0, 2, "B-Z", 0.5), (1, 1, 2, "O", 0.5), (1, 1, 3, "B-X", 0.1)], "doc_id long, w_id int, tok_id int, tag string, score double")
    assert [(r.tok_id, r.tag) for r in K.merge_windows(t, ["doc_id"], 0.2).orderBy("tok_id").collect()] == [(0, "B-X"), (1, "B-Y"), (2, "B-Z"), (3, "O")]


def test_predict_tags(spark):
    """Sentences, first pieces, BIO, characters."""
    from spanlab.sources import predict

    def load():
        def model(sentences):
            out = []
            for words in sentences:
                pieces = []
                for i, w in enumerate(words):
                    if w.istitle():
                        pieces += [(i, "I-N" if i and words[i - 1].istitle() else "B-N", 0.5), (i, "O", 0.9)]
                out.append(pieces)
            return out

        return model

    d = spark.createDataFrame([(1, "see Anna Berg\nBerg é Carl"), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(tuple(r) for r in predict.predict_tags(d, load, batch=1).select("doc_id", "label", "begin", "end", "score").collect())
    assert got == [(1, "N", 4, 13, 0.5), (1, "N", 14, 18, 0.5), (1, "N", 21, 25, 0.5)]


def test_places_by_document(spark):
    """Documents without a key are alike, tokens come in any order, a document without tokens has none; tokens are not sorted as rows."""
    t = spark.createDataFrame([(None, 1, 4, 6), ("a", 2, 7, 9), (None, 0, 0, 3), ("a", 0, 0, 3), ("a", 1, 4, 6)], "doc_id string, tok_id int, begin int, end int")
    s = spark.createDataFrame([(None, 0, 6, "x"), ("a", 4, 9, "y"), ("a", 0, 3, None), ("b", 0, 1, "z"), ("b", 0, 1, "z")], "doc_id string, begin int, end int, label string")
    got = K.to_token_span(t, s)
    assert sorted(got.collect(), key=str) == sorted([(None, 0, 6, "x", 0, 1), ("a", 4, 9, "y", 1, 2), ("a", 0, 3, None, 0, 0), ("b", 0, 1, "z", None, None), ("b", 0, 1, "z", None, None)], key=str)
    assert "Sort [" not in got._jdf.queryExecution().executedPlan().toString()
    assert K.to_token_span(t, s.where("false")).count() == 0 and K.to_token_span(t.where("false"), s).where("first is null").count() == 5
