"""Hard negatives, spelling variants and shards: against brute force, on awkward rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlab.llm import negatives, queries, shards, spelling
from spanlab.llm.negatives import mine_negatives

# --- hard negatives ----------------------------------------------------------------------------------------------


def usable(r):
    return r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])


def brute_negatives(rows, is_anchor, positives=5, negatives_=10, scale=256):
    rows = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in filter(usable, rows)]
    out = []
    for n, (a, y, q) in enumerate(rows):
        if not is_anchor(a):
            continue
        score = [(sum(x * z for x, z in zip(q, v)), b, yb) for m, (b, yb, v) in enumerate(rows) if m != n and len(v) == len(q)]
        score.sort(key=lambda x: (-x[0], x[1]))
        for ps, p, _ in [s for s in score if s[2] == y][:positives]:
            hard = [s for s in score if s[2] != y and 30 * ps <= 100 * s[0] <= 90 * ps][:negatives_]
            out += [(a, p, k, b, ps, s) for k, (s, b, _) in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, is_anchor, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"rid": F.lit("x"), "x": F.lit(1), "score": F.lit(0), "anchor": F.lit("a"), "k": F.lit(2)})
    return sorted(tuple(r) for r in mine_negatives(df, is_anchor, **more).collect())


def vectors(seed, n, dim, labels=3):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, rng.randrange(labels), [c + rng.gauss(0, 0.6) for c in rng.choice(centre)]) for i in range(n)]


@pytest.mark.parametrize("block, gather", [(4096, 64), (16, 1)])
def test_negatives_brute(spark, monkeypatch, block, gather):
    """Small blocks and buckets make every round and the digits of ids run; ties, repeats, odd rows and a shared vector are in the data."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "GATHER", gather)
    rows = vectors(1, 90, 4)
    rows += [(1000 + i, 2, rows[3][2]) for i in range(40)] + [(2000 + i, 0, rows[3][2]) for i in range(40)]  # one vector, a third of all rows
    rows += [rows[10], rows[10], rows[3], (20, 1, rows[20][2])]  # repeated rows, anchors too
    rows += [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (310, 1, None), (320, 1, [1.0, None, 1.0, 1.0]), (330, 1, [math.nan] * 4), (340, 1, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(350, 1, [0.0] * 4), (360, 1, [1.0, 2.0]), (370, 2, [1.0, 1.5]), (380, 1, [0.9, 2.1]), (390, 1, []), (-10, 0, rows[5][2]), (-(2**62), 1, rows[6][2]), (2**62, 2, rows[6][2])]
    got = mined(spark, rows, F.col("vec_id") % 10 == 0)
    assert got == brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(got) > 300 and any(r[4] != r[5] for r in got)


def test_negatives_more(spark):
    rows = vectors(2, 40, 3)
    assert mined(spark, rows, F.lit(None).cast("boolean")) == [] and mined(spark, [], F.lit(True)) == []
    assert mined(spark, [(i, 1, None) for i in range(3)], F.lit(True)) == []
    assert mined(spark, rows, F.col("vec_id") < 4, positives=2, negatives=3) == brute_negatives(rows, lambda i: i < 4, 2, 3)
    big = [(i, y, [x * 2**18 for x in v]) for i, y, v in rows]  # scores beyond what double precision holds
    assert mined(spark, big, F.col("vec_id") < 9) == brute_negatives(big, lambda i: i < 9)
    with pytest.raises(ArithmeticError):
        mined(spark, [(i, y, [x * 1e200 for x in v]) for i, y, v in rows], F.lit(True))


# --- spelling ----------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, least, count, ratio):
    n = {w: k for w, k in Counter(w for w in words if w is not None and len(w) >= least).items() if k >= count}
    of = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in of.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(of[w]), n.get(form[w])))
    return sorted(out)


def formed(spark, words, **more):
    df = spark.createDataFrame([(w,) for w in words], "word string").withColumns({"wid": F.lit("x"), "n": F.lit(1), "key": F.lit(2)})
    return sorted(tuple(r) for r in spelling.spelling_forms(df, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed, letters", [(1, "ab"), (2, "abé"), (3, "aÿ𝔘")])
def test_spelling_brute(spark, seed, letters):
    """Few letters make runs of equal ones, many near words of each kind and ties in n."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(150)]
    words = [w for w in words for _ in range(rng.choice([1, 2, 2, 4, 5, 9, 30]))] + [None, "", letters * 300, letters * 300, letters * 300 + "a"]
    for least, count, ratio in ((3, 2, 2), (1, 1, 4), (7, 1, 2)):
        assert formed(spark, words, min_chars=least, min_count=count, ratio=ratio) == brute_forms(words, least, count, ratio)


def test_spelling_chain(spark):
    """Forms are followed to the last, however many steps there are."""
    words = [w for k, w in enumerate(["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]) for _ in range(2 * 3**k)]
    got = formed(spark, words, min_chars=7, min_count=2, ratio=3)
    assert got == brute_forms(words, 7, 2, 3) and {r[2] for r in got} == {"aabbbbb"}
    assert formed(spark, []) == []
    with pytest.raises(ValueError):
        formed(spark, words, ratio=1)


def test_long_words(spark):
    """A word's groups take time and rows in proportion to its length."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef") for _ in range(100_000))
    got = formed(spark, [long] * 20 + [long[:-1] + "z"] * 2 + [long[:500] + long[501:]] * 3)
    assert sorted((r[3], r[4], r[5] or 0) for r in got) == [(2, 1, 20), (3, 1, 0), (20, 2, 0)]


def test_misspelt_words(spark, odd):
    import re

    got = Counter(r.word for r in queries.misspelt_words(odd, 4).collect())
    want = Counter()
    for i, t in [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if len(run) >= 4:
                want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    assert got == want


# --- shards ------------------------------------------------------------------------------------------------------


def check_shards(rows, n, law, total):
    """Slots are gapless in each shard, and the law holds as far as whole rows allow."""
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n)) and len(rows) == total
    for x in by.values():
        assert sorted(r.slot for r in x) == [*range(len(x))]
    if law == "rows":
        sizes = [len(by.get(s, [])) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1
    else:
        sizes = [sum(r.size for r in by.get(s, [])) for s in range(n)]
        below = [*itertools.accumulate(sizes)]
        biggest = max((r.size for r in rows), default=0)
        assert all(abs(b - sum(sizes) * (j + 1) // n) <= biggest / 2 + 1e-4 * sum(sizes) / n + 1 for j, b in enumerate(below))


@pytest.mark.parametrize("law", shards.LAWS)
def test_shards(spark, odd, law):
    """A third of all rows has one text; rows of one id and text are repeated a hundred times."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randrange(200)))) for i in range(300)] + [(i, "one text") for i in range(300, 450)] + [(7, "again")] * 100 + [(None, None)] * 30 + [(8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("p"), "__k0": F.lit(1), "shard": F.lit("mine"), "Slot": F.lit(0)})
    for n in (1, 5, 24):
        out = shards.shard_documents(docs, n, law, rows_a_part=10)
        assert set(out.columns) == {"doc_id", "text", "part", "__k0", "size", "shard", "slot"}
        got = out.collect()
        check_shards(got, n, law, len(rows))
        assert Counter((r.doc_id, r.text, r.size) for r in got) == Counter((i, t, len((t or "").encode()) + 8) for i, t in rows)
    small = shards.shard_documents(odd, 24, law).collect()
    check_shards(small, 24, law, odd.count())


def test_shards_same(spark):
    """Where rows go does not depend on how they are dealt over tasks."""
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text")
    one = {r.doc_id: r.shard for r in shards.shard_documents(docs.coalesce(1), 7).collect()}
    assert one == {r.doc_id: r.shard for r in shards.shard_documents(docs.repartition(9), 7).collect()} and len(set(one.values())) == 7


def test_shards_empty(spark, empty, tmp_path):
    out = shards.shard_documents(empty, 24)
    assert out.count() == 0 and {"shard", "slot", "size"} <= set(out.columns)
    with pytest.raises(ValueError):
        shards.shard_documents(empty, 24, "other")
    docs = spark.range(40).selectExpr("id AS doc_id", "'a' AS text")
    shards.write_shards(shards.shard_documents(docs, 4, "rows"), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 10, 1: 10, 2: 10, 3: 10}


def test_native(spark, odd):
    """No Python worker stands on sharding's plan."""
    plan = shards.shard_documents(odd, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
