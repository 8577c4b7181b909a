"""Sweeps, islands and ladders against plain loops, and on one very large document."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from spanlab.operators import match as M
from spanlab.operators import spans as P
from spanlab.operators import tokens as K


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def tokens_of(rng, n, gap=3, size=5):
    at, out = 0, []
    for i in range(n):
        at += rng.randrange(gap)
        e = at + rng.randrange(1, size)
        out.append((i, at, e))
        at = e
    return out


def plain_token_span(toks, b, e, cascade):
    head = [i for i, x, y in toks if x <= b < y]
    tail = [i for i, x, y in toks if x < e <= y]
    if not cascade:
        return (min(head), max(tail)) if head and tail else (None, None)
    inside = [i for i, x, y in toks if x >= b and y <= e]
    touch = [i for i, x, y in toks if x < e and b < y]
    if any(x == b for _, x, _ in toks) and any(y == e for _, _, y in toks):
        return "strict", min(head), max(tail)
    if head and tail:
        return "expand", min(head), max(tail)
    if inside:
        return "contract", min(inside), max(inside)
    if touch:
        return "overlap", min(touch), max(touch)
    if toks:
        near = min(toks, key=lambda t: (min(abs(t[1] - b), abs(t[2] - e)), t[0]))[0]
        return "nearest", near, near
    return None, None, None


@pytest.mark.parametrize("cascade", [False, True])
def test_token_spans(spark, cascade):
    rng = random.Random(1)
    docs = {d: tokens_of(rng, n, gap, size) for d, (n, gap, size) in enumerate([(30, 4, 5), (1, 2, 9), (50, 1, 2), (20, 9, 3), (0, 2, 2)])}
    t = spark.createDataFrame([(d, *x) for d, ts in docs.items() for x in ts], "doc_id int, tok_id int, begin int, end int")
    s = [(d, b, b + rng.randrange(1, 12), f"{k}") for d in [*docs, 9] for k, b in enumerate(rng.choices(range(120), k=60))]
    s += s[:20]
    got = K.to_token_span(t, spark.createDataFrame(s, "doc_id int, begin int, end int, text string"), cascade=cascade)
    cols = (["how"] if cascade else []) + ["first", "last"]
    want = sorted(((*x, *plain_token_span(docs.get(x[0], []), x[1], x[2], cascade)) for x in s), key=repr)
    assert rows(got, "doc_id", "begin", "end", "text", *cols) == want


def test_longest_tags(spark):
    """Competing spans, spans that touch a token by one character, spans without a token, repeats."""
    rng = random.Random(2)
    docs = {d: tokens_of(rng, 40) for d in range(4)}
    s = [(d, b, b + rng.randrange(1, 25), rng.choice("AB")) for d in range(5) for b in rng.choices(range(110), k=25)]
    want = []
    for d, toks in docs.items():
        tag = {i: "O" for i, _, _ in toks}
        for _, b, e, x in sorted({(x[1] - x[2], x[1], x[2], x[3]) for x in s if x[0] == d}, key=lambda x: (x[0], x[1], x[3])):
            on = [i for i, y, z in toks if y < e and b < z]
            if on and all(tag[i] == "O" for i in on):
                tag |= {i: ("B-" if i == on[0] else "I-") + x for i in on}
        want += [(d, i, tag[i]) for i in tag]
    t = spark.createDataFrame([(d, *x) for d, ts in docs.items() for x in ts], "doc_id int, tok_id int, begin int, end int")
    got = K.bio_tags_longest(t, spark.createDataFrame(s, "doc_id int, begin int, end int, label string"))
    assert rows(got, "doc_id", "tok_id", "tag") == sorted(want, key=repr)


def test_sentence_starts(spark):
    rng = random.Random(3)
    texts = {d: "".join(rng.choice("ab \n") for _ in range(200)) for d in range(5)} | {7: "no break", 8: "\n\n", 9: "a\nb"}
    docs = spark.createDataFrame([*texts.items()], "doc_id int, text string")
    for pattern in (r"\w+", r"[^ ]+", r"a|\n"):  # tokens that hold or are line breaks, too
        t = K.tokenize(docs, pattern=pattern).withColumn("extra", F.lit(1))
        want = []
        for d in texts:
            n, end = 0, None
            for r in sorted((r for r in t.collect() if r.doc_id == d), key=lambda r: r.tok_id):
                n += end is not None and "\n" in texts[d][end : r.begin]
                want.append((d, r.tok_id, n))
                end = r.end
        assert rows(K.sentence_starts(t, docs), "doc_id", "tok_id", "sent_id") == sorted(want, key=repr)


def spans_of(rng, n, places, size, docs=3):
    out = []
    for _ in range(n):
        b = rng.randrange(places)
        out.append((rng.randrange(docs), rng.choice("AB"), b, b + rng.randrange(1, size)))
    return out


def score(metric, a, b):
    both = max(0, min(a[1], b[1]) - max(a[0], b[0]))
    g, p = a[1] - a[0], b[1] - b[0]
    return both / {"min": min(g, p), "iou": g + p - both, "gold": g}[metric]


def plain_match(gold, pred, metric, threshold, first_fit):
    out = []
    for key in {x[:2] for x in gold + pred}:
        g, p = (sorted(x[2:] for x in side if x[:2] == key) for side in (gold, pred))
        left, tp = list(g), 0
        if first_fit:
            for x in p:
                fit = next((y for y in left if score(metric, y, x) >= threshold), None)
                if fit is not None:
                    left.remove(fit)
                    tp += 1
        else:
            right = list(p)
            pairs = {(y, x) for y in g for x in p if score(metric, y, x) >= threshold}
            for y, x in sorted(pairs, key=lambda q: (-score(metric, *q), q[0][1] - q[0][0], q[1][1] - q[1][0], q[0][0], q[1][0])):
                while y in left and x in right:
                    left.remove(y)
                    right.remove(x)
                    tp += 1
        out.append((*key, tp, len(p) - tp, len(g) - tp))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, few", [(None, M.FEW), (4, 0), (4, 100)])
@pytest.mark.parametrize("metric, threshold", [("min", 0.8), ("iou", 0.3), ("gold", 0.5)])
def test_whole_match(spark, monkeypatch, metric, threshold, width, few):
    """Contested groups, repeated spans, spans of very unlike lengths."""
    monkeypatch.setattr(M, "FEW", few)
    rng = random.Random(4)
    make = lambda: spans_of(rng, 80, 90, 8) + spans_of(rng, 6, 40, 200) + [(0, "A", 10, 15)] * 3
    gold, pred = make(), make()
    df = lambda x: spark.createDataFrame(x, "doc_id int, label string, begin int, end int")
    for f, fit in ((M.match_overlap, False), (M.match_first_fit, True)):
        assert rows(f(df(gold), df(pred), metric, threshold, width=width), "doc_id", "label", "tp", "fp", "fn") == plain_match(gold, pred, metric, threshold, fit)


@pytest.mark.parametrize("few", [0, 500, M.FEW])
def test_ladder(spark, monkeypatch, few):
    """Bins, alone or beside keys of few pairs, find the pairs that all-against-all finds, each once."""
    monkeypatch.setattr(M, "FEW", few)
    rng = random.Random(5)
    make = lambda: spans_of(rng, 60, 300, 10) + spans_of(rng, 10, 300, 1000) + [(0, "A", -3, 2), (0, "A", -9, -1)]
    g, p = (spark.createDataFrame(make(), "doc_id int, label string, begin int, end int").distinct() for _ in range(2))
    cols = ("doc_id", "label", "gb", "ge", "pb", "pe", "score")
    for width in (1, 8, 64):
        assert rows(M.candidate_pairs(g, p, "gold", 0.01, width=width), *cols) == rows(M.candidate_pairs(g, p, "gold", 0.01), *cols)


def test_disjoint(spark):
    rng = random.Random(6)
    s = [(d, x, b, e, "", rng.randrange(3)) for d, x, b, e in spans_of(rng, 200, 150, 12)] + [(None, "A", 0, 5, "", 1), (None, "B", 3, 9, "", 2)]
    want = []
    for d in {x[0] for x in s}:
        kept = []
        for x in sorted((x for x in s if x[0] == d), key=lambda x: (-x[5], x[2] - x[3], x[2], x[1])):
            if all(x[3] <= y[2] or y[3] <= x[2] for y in kept):
                kept.append(x)
        want += kept
    got = P.resolve_overlaps(spark.createDataFrame(s, "doc_id int, label string, begin int, end int, text string, priority int"))
    assert rows(got, "doc_id", "label", "begin", "end", "text", "priority") == sorted(want, key=repr)


def test_one_long_document(spark):
    """200,000 tokens and 100,000 spans of one document, one of which covers all of it; no step is square in them."""
    t = spark.range(200_000).selectExpr("0 AS doc_id", "cast(id AS int) AS tok_id", "cast(id * 5 AS int) AS begin", "cast(id * 5 + 4 AS int) AS end").coalesce(1)
    s = spark.range(100_000).selectExpr("0 AS doc_id", "'A' AS label", "cast(id * 10 + id % 3 AS int) AS begin", "cast(id * 10 + id % 3 + 4 + id % 9 AS int) AS end")
    s = s.unionByName(spark.createDataFrame([(0, "A", 0, 1_000_000)], "doc_id int, label string, begin int, end int"))
    began = time.time()
    assert K.to_token_span(t, s, cascade=True).where("first is null").count() == 0
    tags = K.bio_tags_longest(t, s).groupBy("tag").count().collect()
    assert {r.tag: r["count"] for r in tags} == {"B-A": 1, "I-A": 199_999}
    moved = s.withColumns({"begin": F.col("begin") + 1, "end": F.col("end") + 1})
    r = M.match_overlap(s, moved, "iou", 0.5, width=64).first()
    assert r.tp + r.fn == 100_001 and r.tp > 90_000
    text = spark.createDataFrame([(0, "a b\n" * 100_000)], "doc_id int, text string")
    assert K.sentence_starts(K.tokenize(text), text).agg(F.max("sent_id")).first()[0] == 99_999
    assert time.time() - began < 120


@pytest.mark.parametrize("batch", [1, 7, 200_000])
@pytest.mark.parametrize("strip", [False, True])
def test_tokens_in_batches(spark, monkeypatch, batch, strip):
    """Tokens go on in batches of whole texts; null, empty and blank texts have none, null keys stay null."""
    monkeypatch.setattr(K, "BATCH", batch)
    texts = [(1, "a", " Ünï x-1,5%\n"), (None, "b", "two two"), (2, None, None), (3, "c", ""), (4, "d", " \t "), (1, "a", "again"), (5, "e", "x" * 5000), (6, "f", "日本 😀!")]
    df = spark.createDataFrame(texts, "doc_id long, source string, text string").coalesce(1)
    want = []
    for d, s, t in texts:
        t = (t or "").strip() if strip else (t or "")
        want += [(d, s, i, m.group(), m.start(), m.end()) for i, m in enumerate(re.finditer(r"\w+|[^\w\s]", t))]
    got = K.tokenize(df, keep=["doc_id", "source"], strip=strip)
    assert [tuple(r) for r in got.collect()] == want
    assert K.tokenize(df.where("false")).count() == 0


def test_few_spans_are_shuffled_once(spark, monkeypatch):
    """Without crowded keys both sides are joined as they are; with them the same pairs come by bins."""
    g = spark.createDataFrame([(d, "L", 10 * i, 10 * i + 9) for d in range(3) for i in range(5)], "doc_id int, label string, begin int, end int")
    p = g.withColumns({"begin": F.col("begin") + 1, "end": F.col("end") + 1})
    few = M.candidate_pairs(g, p, "min", 0.8, width=16)
    assert few._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2
    monkeypatch.setattr(M, "FEW", 4)
    assert sorted(few.collect()) == sorted(M.candidate_pairs(g, p, "min", 0.8, width=16).collect()) and few.count() == 15
