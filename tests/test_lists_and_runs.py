"""Entity lists, accents, runs that are taken up again, counts by split, small columns."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import evaluate as E
from spanlab.operators import spans as P
from spanlab.operators import tokens as K
from spanlab.sources import brat, ledger, sinks


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- entities ----------------------------------------------------------------------------------------------------


def test_entity_lists_are_single_entities(spark):
    """Overlapping, nested, repeated and case-equal entities, and an İ, whose lower case is longer."""
    rng = random.Random(1)
    docs = {i: "".join(rng.choice("abAB İx") for _ in range(rng.randrange(60))) for i in range(30)} | {40: None, 41: "", 42: "a" * 500}
    ents = [(i, "".join(rng.choice("abAB x") for _ in range(rng.randrange(4))), k) for i in (*docs, 99) for k in range(6)]
    ents += [(42, "aa", 0), (42, "AA", 1), (42, "aa", 2), (42, None, 3), (3, "İx", 4)]
    d = spark.createDataFrame([*docs.items()], "doc_id int, text string")
    e = spark.createDataFrame(ents, "doc_id int, entity string, label int")
    got = P.find_entities(d, e)
    assert got.columns == ["doc_id", "entity", "label", "begin", "end"]
    want = P.find_occurrences(e.join(d, "doc_id").select("doc_id", "entity", "label", "text"))
    assert rows(got, *got.columns) == rows(want, *got.columns) and got.count() > 1500


def test_entities_in_tokens(spark):
    rng = random.Random(2)
    toks = [(d, i, "".join(rng.choice("aAb") for _ in range(rng.randrange(1, 4)))) for d in range(6) for i in range(rng.randrange(1, 30))]
    ents = [(d, x) for d in range(7) for x in ("a", "ab", "b a", "a a", " b", "a ", "ba b", "")]
    want = []
    for d, ent in ents:
        words = [t for k, _, t in sorted(toks) if k == d]
        text, at, places = " ".join(words).lower(), 0, []
        for w in words:
            places.append((at, at + len(w)))
            at += len(w) + 1
        i = text.find(ent) if ent and words else -1
        while i >= 0:
            first = [k for k, (b, e) in enumerate(places) if b <= i < e]
            last = [k for k, (b, e) in enumerate(places) if b < i + len(ent) <= e]
            if first and last:
                want.append((d, ent, first[0], last[0]))
            i = text.find(ent, i + 1)
    got = K.find_in_tokens(spark.createDataFrame(toks, "doc_id int, tok_id int, token string"), spark.createDataFrame(ents, "doc_id int, entity string"))
    assert rows(got, "doc_id", "entity", "first", "last") == sorted(want, key=repr)


# --- text --------------------------------------------------------------------------------------------------------


def test_accents_by_code_point(spark):
    """Every assigned code point, and marks in strings, lose what the standard library's decomposition takes from them."""
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    points = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i)) != "Cn" and not 0x4E00 <= i < 0x9F00]
    points = [c for c in points if unicodedata.category(c) == "Mn" or not unicodedata.combining(c)]  # the order of spacing marks is kept
    texts = ["".join(points[i : i + 500]) for i in range(0, len(points), 500)] + ["Crème brûlée", "ascii", "", "각한글 test", "ȩ́", "ொக", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in d.select("i", T.strip_accents("t").alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else bare(t)), i
    assert "Python" not in d.select(T.normalized("t"))._jdf.queryExecution().executedPlan().toString()
    same = spark.createDataFrame([("Été", "ETE", True), ("ete", "eta", False)], "a string, b string, want boolean")
    assert all(r.x == r.want for r in same.select("want", T.same_text("a", "b").alias("x")).collect())


def test_small_columns(spark):
    d = spark.createDataFrame([("3", "two words\tx", "dev_rules")], "k string, v string, m string")
    table = F.create_map(F.lit("3"), F.lit("B-X"))
    r = d.select(T.label_of(table, "k").alias("a"), T.label_of(table, F.lit(4)).alias("b"), T.sanitize_value("v").alias("c")).first()
    assert tuple(r) == ("B-X", "O", "two_words_x")
    diag = spark.createDataFrame([(1.0, 0.5, 0.4), (1.0, 0.43, 0.4), (1.0, 0.4, 0.4), (0.4, 0.4, 0.4)], "f double, l double, m double")
    assert [x.d for x in diag.select(T.fit_diagnosis("f", "l", "m").alias("d")).collect()] == ["OVER", "MILD", "GOOD", "UNDER"]


# --- runs that are taken up again ----------------------------------------------------------------------------------


def test_resume_after_a_kill(spark, tmp_path):
    """A run that dies half way, then a whole one: the same table as one run, and no document is worked twice."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)] + [(7, "a second row"), (None, "no id")], "doc_id int, text string")
    worked, calls = [], []

    def work(d):
        worked.append(d)
        if len(calls) == 3:
            raise RuntimeError("killed")
        calls.append(1)
        return d.where("doc_id is null or doc_id % 10 <> 3").select("doc_id", F.length("text").alias("n"))

    path = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        ledger.resume(docs, work, path, batches=4)
    half = len(ledger.Ledger(spark, path).commits())
    assert half == 2  # the first call only asks for the schema
    calls.clear()
    worked.clear()
    calls.extend([1] * 4)
    out = ledger.resume(docs, work, path, batches=4)
    want = rows(docs.where("doc_id is null or doc_id % 10 <> 3").select("doc_id", F.length("text").alias("n")), "doc_id", "n")
    assert rows(out, "doc_id", "n") == want
    assert len(worked) == 1 + 2 and len(ledger.Ledger(spark, path).commits()) == 4
    worked.clear()
    assert rows(ledger.resume(docs, work, path, batches=3), "doc_id", "n") == want and len(worked) == 1  # nothing is open, whatever the batches


def test_changed_texts_and_two_attempts(spark, tmp_path):
    work = lambda d: d.select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    path = str(tmp_path / "ledger")
    one = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None)], "doc_id int, text string")
    assert rows(ledger.resume(one, work, path), "doc_id", "w") == [(1, "a"), (1, "b"), (2, "c")]
    two = spark.createDataFrame([(1, "x"), (2, "c"), (4, "d e")], "doc_id int, text string")
    assert rows(ledger.resume(two, work, path), "doc_id", "w") == [(1, "x"), (2, "c"), (4, "d"), (4, "e")]
    # a second attempt at the same documents commits too: its rows replace the first's
    book = ledger.Ledger(spark, path)
    again = spark.createDataFrame([(2,)], "doc_id int").select(F.col("doc_id").alias("key"), F.lit(0).cast("long").alias("content"))
    book.add(again, spark.createDataFrame([(2, "late")], "doc_id int, w string"))
    assert rows(book.rows(two.select("doc_id", F.lit("").alias("w")).schema, "doc_id"), "doc_id", "w") == [(1, "x"), (2, "late"), (4, "d"), (4, "e")]
    other = ledger.resume(two, work, path, run_id="other")
    assert other.count() == 4 and len(book.commits()) == 3


# --- tables ------------------------------------------------------------------------------------------------------


def test_split_counts(spark):
    s = spark.createDataFrame([(1, "A", True), (1, "B", False), (2, "A", None), (9, "A", True)], "doc_id int, label string, negated boolean")
    r = spark.createDataFrame([(1, "R"), (2, "R"), (2, "Q")], "doc_id int, type string")
    f = spark.createDataFrame([(1, "train"), (2, "test"), (1, "train")], "doc_id int, fold string")
    assert rows(E.split_counts(s, f, r), "fold", "kind", "key", "n") == [
        ("test", "label", "A", 1), ("test", "relation", "Q", 1), ("test", "relation", "R", 1),
        ("train", "label", "A", 1), ("train", "label", "B", 1), ("train", "negated", "A", 1), ("train", "relation", "R", 1),
    ]


def test_split_counts_sort_no_spans(spark):
    """A task holds the split and the attributes, a row each, and spans are not sorted; null and repeated keys count as they did."""
    lines = [(1, "T1\tA 0 1\tx"), (1, "T1\tB 2 3\ty"), (1, "T2\tA 4 5\tz"), (2, "T1\tA 0 1\tx"), (None, "T1\tA 0 1\tx"), (7, "T1\tA 0 1\tx"), (1, "R1\tQ Arg1:T1 Arg2:T2"),
             (1, "A1\tNegated T1 true"), (1, "A2\tnegated T1 false"), (1, "M3\tNEGATED T1"), (1, "A4\tNegated T2 False"), (1, "A5\tOther T2 true"), (2, "A1\tNegated T9"), (None, "A1\tNegated T1")]
    l = spark.createDataFrame(lines, "doc_id int, line string").withColumn("line_no", F.lit(0))  # noqa: E741
    f = spark.createDataFrame([(1, "train"), (1, "train"), (1, "all"), (2, None), (None, "all"), (8, "all")], "doc_id int, fold string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        s = P.attach_attribute(brat.parse_spans(l), brat.parse_attributes(l), "Negated", "negated")
        assert sorted((str(r.doc_id), r.tid, r.label, r.negated) for r in s.collect()) == [("1", "T1", "A", True), ("1", "T1", "B", True), ("1", "T2", "A", False), ("2", "T1", "A", False), ("7", "T1", "A", False), ("None", "T1", "A", False)]
        n = E.split_counts(s.withColumn("label", F.when(F.col("label") != "B", F.col("label"))), f, brat.parse_relations(l))
        plan = n._jdf.queryExecution().executedPlan().toString()
        one = [("label", "A", 2), ("label", None, 1), ("negated", "A", 1), ("negated", None, 1), ("relation", "Q", 1)]
        assert sorted(map(str, (tuple(r) for r in n.select("fold", "kind", "key", "n").collect()))) == sorted(map(str, [(x, *k) for x in ("train", "all") for k in one] + [(None, "label", "A", 1)]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Sort" not in plan and plan.count("ShuffledHashJoin") == 2


def test_first_rows(spark):
    d = spark.range(1000).selectExpr("id", "id % 7 AS x").repartition(6)
    got = [tuple(r) for r in E.first_rows(d, [F.desc("x"), "id"], 5).collect()]
    assert got == [(6, 6, 1), (13, 6, 2), (20, 6, 3), (27, 6, 4), (34, 6, 5)]


def test_appended_csv(spark, tmp_path):
    """Each file has its header, so appended tables read as one."""
    d = spark.createDataFrame([(1, "a,b"), (2, 'q"')], "i int, t string")
    for _ in range(2):
        sinks.write_table(d, str(tmp_path / "c"), "csv", mode="append", one_file=True)
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert rows(back, "i", "t") == [("1", "a,b"), ("1", "a,b"), ("2", 'q"'), ("2", 'q"')] or back.count() == 4


def test_label_filter_and_tabs(spark):
    lines = spark.createDataFrame([("d", 0, "T1\tA 0 1\tx"), ("d", 1, "T2\tB 1 2\ty"), ("d", 2, "T3\tA 5 6;8 9\tz")], "doc_id string, line_no int, line string")
    assert rows(brat.parse_spans(lines, labels=["A"]), "tid", "begin", "end") == [("T1", 0, 1), ("T3", 5, 9)]
    bag = brat.span_bag(brat.parse_spans(lines.union(lines)))
    assert rows(bag, "label", "n") == [("A", 2), ("A", 2), ("B", 2)]
    s = spark.createDataFrame([("d", "A", 0, 3, "a\tb")], "doc_id string, label string, begin int, end int, text string")
    assert sinks.brat_text(s, tabs=True).first().content == "T1\tA 0 3\ta b\n" and sinks.brat_text(s).first().content == "T1\tA 0 3\ta\tb\n"


def test_matches_come_in_bounded_parts(spark, monkeypatch):
    """What Python holds does not grow with a batch of documents: matches go out in parts of at most BATCH rows, one text over several."""
    from spanlab.operators import spans as P
    from spanlab.operators import tokens as K

    monkeypatch.setattr(P, "BATCH", 50)
    monkeypatch.setattr(K, "BATCH", 50)
    docs = spark.createDataFrame([(i, "the 12 a " * n) for i, n in enumerate((0, 1, 70, 49, 3, 120))] + [(None, "the"), (9, None)], "doc_id long, text string").coalesce(1)
    n = 1 + 70 + 49 + 3 + 120
    spans = P.extract_spans(docs, [("the", "X", 1), ("[0-9]+", "N", 2)])
    assert [spans.where(f"label = '{x}'").count() for x in "XN"] == [n + 1, n]
    assert spans.where("text <> substring('the 12 a ', begin % 9 + 1, end - begin)").count() == 0
    tokens = K.tokenize(docs)
    assert {r.doc_id: (r.n, r.first, r.last, r.ids) for r in tokens.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("tok_id").alias("first"), F.max("tok_id").alias("last"), F.countDistinct("tok_id").alias("ids")).collect()} == {None: (1, 0, 0, 1)} | {i: (3 * k, 0, 3 * k - 1, 3 * k) for i, k in ((1, 1), (2, 70), (3, 49), (4, 3), (5, 120))}
    found = P.find_entities(docs, docs.where("doc_id is not null").select("doc_id", F.explode(F.array(F.lit("THE"), F.lit("e 1"))).alias("entity")))
    assert found.count() == 2 * n and found.where("begin % 9 <> if(entity = 'THE', 0, 2)").count() == 0
    made = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, _: made.append((df, f)) or df)
    P.extract_spans(docs, [("the", "X", 1), ("[0-9]+", "N", 2)])
    K.tokenize(docs)
    for df, f in made:
        assert max(b.num_rows for b in f(iter(df.toArrow().combine_chunks().to_batches()))) == 50
