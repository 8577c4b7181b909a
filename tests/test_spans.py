"""Reading, matching and resolving spans: hand-derived expectations."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spanlab.functions import text as T
from spanlab.operators import evaluate as E
from spanlab.operators import match as M
from spanlab.operators import spans as P
from spanlab.sources import brat

ANN = "T1\tDRUG 0 7\taspirin\nT2\tSITE 10 14;20 25\tleft wrist\nT3\tDRUG 0 7\taspirin\nT4\tBAD x y\toops\nT5\tSITE 30 34\nA1\tNegated T1\nR1\tLINK Arg1:T1 Arg2:T2\nE1\tGIVE:T1\n#1\tAnnotatorNotes T1\tfree note\n*\tOVERLAP T1 T2"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def lines(spark):
    return brat.lines_of(spark.createDataFrame([("d", ANN)], "doc_id string, text string"))


def test_policies(lines):
    env = brat.span_set(brat.parse_spans(lines, "envelope"))
    assert rows(env, "begin", "end", "label") == [(0, 7, "DRUG"), (10, 25, "SITE")]
    bag = brat.span_bag(brat.parse_spans(lines, "first_fragment", min_fields=2))
    assert rows(bag, "label", "begin", "end", "n") == [("DRUG", 0, 7, 2), ("SITE", 10, 14, 1), ("SITE", 30, 34, 1)]
    frags = brat.parse_spans(lines, "all_fragments").where("tid = 'T2'")
    assert rows(frags, "begin", "end") == [(10, 14), (20, 25)]
    assert rows(brat.parse_spans(lines, "first_end").where("tid = 'T2'"), "begin", "end") == [(10, 14)]
    assert "oops" in {r.text for r in brat.parse_spans(lines, "ignore_offsets").collect()}
    with pytest.raises(ValueError):
        brat.parse_spans(lines, "other")


def test_fragments_of_odd_offsets(spark):
    """All policies on offsets with odd blanks, breaks and numbers; fragments are looked for once a line."""
    heads = ["A 1 2", "A 1  2 ;\u00203 4", "A 1 2;3 4;5 66", "A 7 8\r", "A 1 2;", "A 1", "A x 2", "A 1 99999999999;3 4", " A 1 2", "A", ""]
    lines = spark.createDataFrame([("d", i, f"T{i}\t{h}\tx") for i, h in enumerate(heads)], "doc_id string, line_no int, line string")
    got = {p: {} for p in ("envelope", "first_fragment", "all_fragments")}
    for p, of in got.items():
        for r in brat.parse_spans(lines, p).orderBy("line_no", "begin").collect():
            of.setdefault(r.line_no, []).append((r.begin, r.end))
    assert got["all_fragments"] == {0: [(1, 2)], 1: [(1, 2), (3, 4)], 2: [(1, 2), (3, 4), (5, 66)], 3: [(7, 8)], 7: [(1, None), (3, 4)]} | ({8: [(1, 2)]} if 8 in got["envelope"] else {})
    for p, of in got.items():
        assert p == "all_fragments" or of == {k: [(v[0][0], v[-1 if p == "envelope" else 0][1])] for k, v in got["all_fragments"].items()}
    plan = brat.parse_spans(lines, "all_fragments")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "transform(" not in plan



def test_attributes_relations_events(lines):
    s = brat.parse_spans(lines)
    neg = P.attach_attribute(s, brat.parse_attributes(lines), "negated", "neg")
    assert rows(neg, "tid", "neg") == [("T1", True), ("T2", False), ("T3", False)]
    rel = P.resolve_relations(brat.parse_relations(lines), s, brat.parse_events(lines))
    assert [(r.type, r["head"].label, r["tail"].label) for r in rel.collect()] == [("LINK", "DRUG", "SITE")]
    assert rows(brat.kind_counts(lines), "key", "n")[-1] == ("SITE", 2)


SPANS = "doc_id string, label string, begin int, end int"


def span_frame(spark, spans, label="X"):
    return spark.createDataFrame([("d", label, b, e) for b, e in spans], SPANS)


@pytest.mark.parametrize(
    "metric, threshold, expected",
    [("exact", 1.0, (1, 3, 2)), ("min", 0.8, (2, 2, 1)), ("iou", 0.95, (1, 3, 2)), ("gold", 0.85, (2, 2, 1))],
)
def test_overlap_matching(spark, metric, threshold, expected):
    g, p = span_frame(spark, [(0, 10), (20, 30), (40, 44)]), span_frame(spark, [(0, 9), (20, 30), (21, 29), (60, 65)])
    assert [tuple(r) for r in M.match_overlap(g, p, metric, threshold).select("tp", "fp", "fn").collect()] == [expected]
    none = span_frame(spark, [])
    assert rows(M.match_overlap(g, none, metric, threshold), "tp", "fp", "fn") == [(0, 0, 3)]


def test_bag_set_first_fit(spark):
    g, p = span_frame(spark, [(5, 9), (5, 9)]), span_frame(spark, [(5, 9)])
    assert rows(M.match_bag(g, p), "tp", "fp", "fn") == [(1, 0, 1)]
    assert rows(M.match_set(g, p), "tp", "fp", "fn") == [(1, 0, 0)]
    assert rows(M.match_first_fit(g, p), "tp", "fp", "fn") == [(1, 0, 1)]
    zero = spark.createDataFrame([("X", 0, 0, 0)], "label string, tp int, fp int, fn int")
    assert rows(E.per_label(zero), "precision", "recall", "f1") == [(0.0, 0.0, 0.0)]


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        P.overlap_score("other", F.lit(0), F.lit(1), F.lit(0), F.lit(1))


def test_match_totals_hold(spark):
    rng = random.Random(3)
    spans = lambda n: [(str(rng.randrange(4)), rng.choice("AB"), b := rng.randrange(60), b + rng.randrange(1, 9)) for _ in range(n)]
    gs, ps = spans(80), spans(70)
    g, p = spark.createDataFrame(gs, SPANS), spark.createDataFrame(ps, SPANS)
    for f in (M.match_bag, M.match_overlap, M.match_first_fit):
        r = f(g, p).groupBy().sum("tp", "fp", "fn").first()
        assert r[0] + r[2] == len(gs) and r[0] + r[1] == len(ps)
    wide = M.candidate_pairs(g.distinct(), p.distinct(), "min", 0.5)
    assert rows(wide, "gb", "ge", "pb", "pe") == rows(M.candidate_pairs(g.distinct(), p.distinct(), "min", 0.5, width=7), "gb", "ge", "pb", "pe")


def resolve(spark, items, **kw):
    df = spark.createDataFrame([("d", la, b, e, "", p) for b, e, la, p in items], SPANS + ", text string, priority int")
    return rows(P.resolve_overlaps(df, **kw), "begin", "end", "label")


def test_resolution(spark):
    items = [(0, 8, "A", 5), (4, 12, "B", 7), (12, 15, "C", 1), (4, 12, "B", 7)]
    assert resolve(spark, items) == [(4, 12, "B"), (12, 15, "C")]
    assert resolve(spark, items, mode="keep_nested") == [(0, 8, "A"), (4, 12, "B"), (12, 15, "C")]
    assert resolve(spark, [(0, 4, "A", 3), (2, 8, "B", 3)]) == [(2, 8, "B")]


def test_resolution_is_disjoint_and_order_free(spark):
    rng = random.Random(5)
    items = [(b := rng.randrange(200), b + rng.randrange(1, 30), rng.choice("ABC"), rng.randrange(4)) for _ in range(150)]
    kept = resolve(spark, items)
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))
    rng.shuffle(items)
    assert resolve(spark, items) == kept
    best = []
    for b, e, la, p in sorted(set(items), key=lambda x: (-x[3], x[0] - x[1], x[0], x[2])):
        if all(e <= y[0] or y[1] <= b for y in best):
            best.append((b, e, la))
    assert sorted(best) == kept


def test_extract_find_merge_nested(spark):
    d = spark.createDataFrame([(1, "Ünï 12% 😀 12"), (2, None), (3, "")], "doc_id long, text string")
    s = P.extract_spans(d, [(r"\d+", "N", 1), (r"\d+%", "P", 2), ("x*", "E", 1)])
    assert rows(s, "doc_id", "label", "begin", "end", "text") == [(1, "N", 4, 6, "12"), (1, "N", 10, 12, "12"), (1, "P", 4, 7, "12%")]
    f = spark.createDataFrame([("aXaxa", "axa"), ("ab", "abc"), ("ab", "")], "text string, entity string")
    assert rows(P.find_occurrences(f), "begin", "end") == [(0, 3), (2, 5)]
    m = spark.createDataFrame([("d", "A", 0, 4, 1.0), ("d", "A", 4, 8, 0.0), ("d", "B", 8, 9, 1.0), ("d", "A", 9, 10, 1.0)], SPANS + ", score double")
    assert rows(P.merge_adjacent(m), "label", "begin", "end", "score") == [("A", 0, 8, 0.5), ("A", 9, 10, 1.0), ("B", 8, 9, 1.0)]
    n = spark.createDataFrame([("d", "A", 0, 9), ("d", "B", 2, 5), ("d", "C", 0, 9), ("d", "D", 8, 12), ("d", "E", 0, 4)], SPANS)
    assert rows(P.drop_nested(n), "label") == [("A",), ("C",), ("D",)]


def test_values(spark):
    d = spark.createDataFrame([("HER2", "HER2 négatif score 1+"), ("ER", "RE 90 %"), ("ER", "RE 5%"), ("PR", "RP négatif"), ("Ki67", "Ki 67: 15 %"), ("Ki67", "Ki"), ("FISH", "FISH non amplifié"), ("HER2", "HER2 +++")], "label string, text string")
    assert rows(P.emit_values(d), "label", "value") == [("Estrogen_receptor", "negatif"), ("Estrogen_receptor", "positif"), ("HER2_FISH", "negatif"), ("HER2_IHC", "1+"), ("HER2_IHC", "3+"), ("HER2_status", "negatif"), ("HER2_status", "positif"), ("Ki67", "15%"), ("Progesterone_receptor", "negatif")]
    told = [  # marker, text, value
        ("ihc", "score 0", "0"), ("ihc", "score 1+", "1+"), ("ihc", "her2 score 3", "3+"), ("ihc", "1+ puis 3+", "3+"), ("ihc", "deux croix", "2+"), ("ihc", "++", "2+"), ("ihc", "her2", None), ("ihc", "her2 +", None),
        ("status", "her2 non amplifie", "negatif"), ("status", "absence de surexpression de her2", "negatif"), ("status", "pas de sur-expression", "negatif"), ("status", "her2 surexprime", "positif"),
        ("status", "her-2 positif", "positif"), ("status", "her2 -", "negatif"), ("status", "her2-", "negatif"), ("status", "her2/lumb", "positif"), ("status", "her2 enrichie", "positif"), ("status", "faible intensite", "negatif"), ("status", "her2", None),
        ("fish", "en cours", "en_cours"), ("fish", "en attente", "en_cours"), ("fish", "non concluante", "non_disponible"), ("fish", "fish positive", "positif"), ("fish", "fish +", "positif"), ("fish", "fish", "non_disponible"), ("fish", "non amplifiee", "negatif"),
        ("old", "non amplifiee", "positif"), ("old", "non amplifi", "negatif"),
        ("receptor", "re 90 %", "positif"), ("receptor", "re 10%", "negatif"), ("receptor", "re 80 % puis 5 %", "negatif"), ("receptor", "re 250", "non_disponible"), ("receptor", "luminal b", "positif"), ("receptor", "tripleneg", "negatif"), ("receptor", "re +", "positif"), ("receptor", "re -", "negatif"),
        ("percent", "ki67 : 20 a 30 %", "30%"), ("percent", "ki", None),
    ]
    made = spark.createDataFrame(told, "marker string, t string, want string")
    by = {"ihc": T.ihc_value("t"), "status": T.status_value("t"), "fish": T.fish_value("t"), "old": T.fish_value("t", compat=True), "receptor": T.receptor_value("t"), "percent": T.percent_value("t")}
    got = F.coalesce(*(F.when(F.col("marker") == k, v) for k, v in by.items()))
    assert [tuple(r) for r in made.select("marker", "t", got).collect()] == told
    r = spark.createDataFrame([("HER2_status", "HER2 ECD gène"), ("HER2_status", "HER2 ECD"), ("HER2_IHC", "FISH ECD pos")], "label string, t string").select(T.rejected("t", "label").alias("r"))
    assert [x.r for x in r.collect()] == [True, False, False]
    r = spark.createDataFrame([("HER2",), ("si HER2",), ("12 ans",), ("anti-HER2",), ("HER2 pos",)], "t string").select(T.rejected("t").alias("r"))
    assert [x.r for x in r.collect()] == [True, True, True, True, False]


def test_occurrences_of_a_long_text(spark):
    """One pass over a million code points; a lower case of more code points moves nothing."""
    text = "İ" + "ab😀" * 333_333
    f = spark.createDataFrame([(text, "AB😀A"), ("İxİX", "ix"), ("İxİX", "x"), (None, "x"), ("x", None)], "text string, entity string")
    began = time.time()
    got = rows(P.find_occurrences(f), "entity", "begin", "end")
    assert time.time() - began < 30
    assert [r for r in got if r[0] != "AB😀A"] == [("x", 1, 2), ("x", 3, 4)] and len(got) == 333_332 + 2 and ("AB😀A", 1, 5) in got
