import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.functions import stats as S
from spanlab.operators import routing as R
from spanlab.operators import significance as G
from spanlab.operators import splits as X


def test_tails():
    assert S.mcnemar_p(8, 2) == 0.109375 and S.mcnemar_p(0, 0) == 1
    assert S.mcnemar_p(30, 10) == pytest.approx(math.erfc(math.sqrt(9.025 / 2)))
    assert S.t_sf2(2.2281388, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.wilcoxon(np.arange(10) + 1.0, np.zeros(10)) == (0.0, 2 / 1024)
    w, p = S.shapiro(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert (w, p) == (pytest.approx(0.78881, abs=1e-4), pytest.approx(0.006704, abs=1e-4))


def test_mcnemar_native(spark):
    d = spark.createDataFrame([(b, c) for b in range(8) for c in range(8)], "b long, c long")
    for r in d.withColumn("p", S.mcnemar_exact(F.col("b"), F.col("c"))).collect():
        assert r.p == pytest.approx(S.mcnemar_p(r.b, r.c))


def test_cochran_and_friedman(spark):
    rows = [("L", *x) for x in [(1, 0, 0)] * 15 + [(0, 1, 0)] * 10 + [(0, 0, 1)] * 5 + [(0, 0, 0)] * 3]
    f = spark.createDataFrame(rows, "label string, rules int, TBM int, LLM int")
    r = G.cochran(f, ["rules", "TBM", "LLM"]).first()
    assert (r.q, r.n_effective, r.n) == (5.0, 30, 33) and r.p == pytest.approx(math.exp(-2.5))
    m = spark.createDataFrame([("L", i, 0.1, 0.2, 0.3) for i in range(10)], "label string, doc_id long, f1_rules double, f1_TBM double, f1_LLM double")
    r = G.friedman(m, ["rules", "TBM", "LLM"]).first()
    assert r.chi2 == pytest.approx(20) and r.p == pytest.approx(math.exp(-10))
    assert {x.why for x in R.route_documents(m.limit(5), ["rules", "TBM", "LLM"]).collect()} == {"excluded"}
    assert R.route_mentions(f, ["rules", "TBM", "LLM"]).first().method == "rules"


def test_paired_tests_of_many_documents(spark):
    """Normality is that of all differences, whatever their order."""
    head = [(S.normal_ppf((i + 0.5) / 5000), 0.0) for i in range(5000)]
    tail = [(40.0, 0.0)] * 1000
    x = np.array([a for a, _ in head + tail])
    assert S.shapiro(x[:5000])[1] > 0.05 >= S.shapiro(x)[1]
    for rows in (head + tail, tail + head):
        m = spark.createDataFrame([("L", i, a, b) for i, (a, b) in enumerate(rows)], "label string, doc_id long, f1_a double, f1_b double").coalesce(1)
        r = G.paired_tests(m, ["a", "b"]).first()
        assert (r.n, r.test, r.winner) == (6000, "wilcoxon", "a")
        assert (r.statistic, r.p) == pytest.approx(S.wilcoxon(x, np.zeros(6000)))


def test_frugal(spark):
    p = spark.createDataFrame([("a", "TBM", True), ("a", "LLM", True), ("b", "LLM", False)], "label string, winner string, significant boolean")
    assert {r.label: r.method for r in R.vote(p, ["rules", "TBM", "LLM"]).collect()} == {"a": "TBM", "b": "rules"}


def test_stratify():
    docs = [f"d{i}" for i in range(60)]
    labels = [{"a"} | ({"b"} if i % 10 == 0 else set()) for i in range(60)]
    out = X.stratify(docs, labels, {"train": 0.8, "test": 0.2}, sizes=True)
    assert sum(v == "test" for v in out.values()) == 12 and out == X.stratify(docs, labels, {"train": 0.8, "test": 0.2}, sizes=True)
    assert {out[f"d{i}"] for i in range(0, 60, 10)} == {"train", "test"}


def test_splits(spark):
    d = spark.range(500).withColumnRenamed("id", "doc_id")
    assert X.exact_split(d, 0.1).where("fold = 'dev'").count() == 50
    a, b = X.hash_split(d).where("fold = 'test'"), X.hash_split(d.where("doc_id < 100")).where("fold = 'test'")
    assert b.join(a, "doc_id", "left_anti").count() == 0
    lab = d.select("doc_id", F.lit("x").alias("label"))
    assert X.stratified_split(lab, {"train": 0.8, "test": 0.2}, strata=3).count() == 500


def test_two_methods(spark):
    """The paired test between two methods decides; the cheapest where it does not tell them apart."""
    kinds = "label string, doc_id long, f1_rules double, f1_TBM double"
    far = [("A", i, 0.1 + 0.001 * (i % 7), 0.9 - 0.002 * (i % 5)) for i in range(40)]
    near = [("B", i, 0.5 + 0.01 * (i % 3), 0.5 + 0.01 * ((i + 1) % 3)) for i in range(30)]
    equal = [("C", i, 0.5, 0.5) for i in range(20)]
    few = [("D", i, 0.1, 0.9) for i in range(9)]
    r = {x.label: x for x in R.route_documents(spark.createDataFrame(far + near + equal + few, kinds), ["rules", "TBM"]).collect()}
    assert (r["A"].method, r["A"].why) == ("TBM", "paired test") and r["A"].p < 0.05
    assert (r["B"].method, r["B"].why) == ("rules", "not significant") and r["B"].p > 0.05
    assert (r["C"].method, r["C"].p) == ("rules", 1.0) and (r["D"].method, r["D"].why) == (None, "excluded")


def test_counted_statistics():
    """Values with counts give what the values one by one give; sums over ranks come near the weights one by one."""
    rng = np.random.default_rng(3)
    for n, spread in ((30, 5), (400, 12), (4000, 40)):
        x = np.round(rng.normal(0.4, 1, n) * spread) / spread
        d, k = np.unique(x, return_counts=True)
        assert S.shapiro(d, k) == pytest.approx(S.shapiro(x))
        assert S.wilcoxon_of(d, k) == pytest.approx(S.wilcoxon(x, np.zeros(n)))
        assert S.paired_t_of(d, k) == pytest.approx(S.paired_t(x, np.zeros(n)))
    whole, S.WHOLE = S.WHOLE, 10**9
    try:
        for x in (rng.normal(size=7000), rng.exponential(size=7000), np.round(rng.normal(size=7000), 1)):
            exact = S.shapiro(x)
            S.WHOLE = 5000
            d, k = np.unique(x, return_counts=True)
            assert S.shapiro(d, k)[0] == pytest.approx(exact[0], abs=2e-4)
            S.WHOLE = 10**9
    finally:
        S.WHOLE = whole


def test_excluded_sparse_significant(spark):
    s = spark.createDataFrame([("m", 1, "A", 0, 0, 0), ("n", 1, "A", 0, 0, 0), ("m", 2, "A", 1, 0, 0), ("n", 2, "A", 0, 0, 1), ("m", 3, "A", 0, 2, 0), ("m", 4, "B", 0, 0, 0)], "method string, doc_id long, label string, tp long, fp long, fn long")
    assert {r.label: r.n_excluded for r in G.excluded_counts(s).collect()} == {"A": 1, "B": 1}
    m = G.score_matrix(s, ["m", "n"])
    assert [(r.label, r.sparsity) for r in G.sparsity(m, ["m", "n"]).collect()] == [("A", 0.5)]
    t = spark.createDataFrame([("A", 10, 0.05), ("B", 9, 0.01), ("C", 50, 0.06), ("D", 50, None), ("E", 50, float("nan"))], "label string, n_docs long, p double")
    assert [r.label for r in G.significant_labels(t).collect()] == ["A"]


def test_moves_and_static_order():
    rng = np.random.default_rng(2)
    docs = [f"d{i}" for i in range(300)]
    labels = [{x for x, p in zip("abcde", (0.5, 0.3, 0.1, 0.05, 0.02)) if rng.random() < p} for _ in docs]
    folds = {"train": 0.7, "dev": 0.1, "test": 0.2}

    def gap(split):
        return sum(abs(sum(x in has for d, has in zip(docs, labels) if split[d] == f) - share * sum(x in has for has in labels)) for f, share in folds.items() for x in "abcde")

    for static in (False, True):
        plain = X.stratify(docs, labels, folds, repair=False, static=static)
        moved = X.stratify(docs, labels, folds, repair=False, static=static, moves=50)
        assert set(plain) == set(moved) == set(docs) and gap(moved) <= gap(plain)
        assert sum(plain[d] != moved[d] for d in docs) <= 50
    skewed = {d: "train" for d in docs}
    has, totals = dict(zip(docs, labels)), {x: sum(x in h for h in labels) for x in "abcde"}
    d, f = X._best_move(skewed, has, totals, folds, list(folds))
    assert f == "test" and len(has[d]) == max(map(len, labels)) or f != "train"


# --- tails, routing of mentions, splits by label sets --------------------------------------------------------------


def test_chi2_tails(spark):
    """Against closed forms for each parity, and values of printed tables."""
    xs = [0.0, 1e-6, 0.01, 0.5, 1.0, 2.0, 3.0, 5.0, 7.0, 10.0, 20.0, 50.0, 200.0, 900.0]

    def plain(x, df):
        if df % 2 == 0:
            return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(df // 2))
        out = math.erfc(math.sqrt(x / 2))
        return out + math.exp(-x / 2) * sum((x / 2) ** (i - 0.5) / math.gamma(i + 0.5) for i in range(1, (df + 1) // 2))

    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for df in (*range(1, 8), 11, 30, 51):
        for r in d.select("x", S.chi2_sf(F.col("x"), df).alias("p")).collect():
            assert r.p == pytest.approx(plain(r.x, df), rel=1e-9, abs=1e-300), (df, r.x)
    table = [(3.841458821, 1, 0.05), (6.634896601, 1, 0.01), (7.814727903, 3, 0.05), (11.34486673, 3, 0.01), (11.07049769, 5, 0.05), (43.77297183, 30, 0.05)]
    for x, df, p in table:
        assert d.limit(1).select(S.chi2_sf(F.lit(x), df)).first()[0] == pytest.approx(p, abs=1e-9)
    assert d.limit(1).select(S.chi2_sf(F.lit(None).cast("double"), 3)).first()[0] is None
    big = [(b, c) for b in (0, 3, 11, 12, 13, 40, 500) for c in (0, 1, 12, 14, 30, 700)]
    for r in spark.createDataFrame(big, "b long, c long").withColumn("p", S.mcnemar(F.col("b"), F.col("c"))).collect():
        assert r.p == pytest.approx(S.mcnemar_p(r.b, r.c), rel=1e-9)


@pytest.mark.parametrize("k", [2, 3, 4, 5, 6])
def test_any_number_of_methods(spark, k):
    names = [f"m{i}" for i in range(k)]
    rng = np.random.default_rng(k)
    f1 = [("L", i, *(float(x) for x in rng.random(k))) for i in range(40)]
    m = spark.createDataFrame(f1, "label string, doc_id long, " + ", ".join(f"f1_{n} double" for n in names))
    r = G.friedman(m, names).first()
    ranks = np.array([[1 + sum(y < x for y in row[2:]) for x in row[2:]] for row in f1])
    chi2 = 12 / (40 * k * (k + 1)) * (ranks.sum(axis=0) ** 2).sum() - 3 * 40 * (k + 1)
    assert r.chi2 == pytest.approx(chi2) and (r.p is None) == (k == 2)
    assert R.route_documents(m, names).first().why in ("not significant", "vote", "paired test")


def routed(spark, rows, names):
    f = spark.createDataFrame([("L", *(int(v) for v in x)) for x in rows], "label string, " + ", ".join(f"{n} int" for n in names))
    r = R.route_mentions(f, names).first()
    return r.method, r.why, r.p


def test_route_mentions(spark):
    """Two to four methods: a missing p is no significance, agreement is none, and two methods are held to McNemar."""
    rng = np.random.default_rng(0)
    two, three, four = ["rules", "TBM"], ["rules", "TBM", "LLM"], ["rules", "TBM", "LLM", "X"]
    method, why, p = routed(spark, rng.integers(0, 2, (200, 2)), two)
    assert (method, why) == ("rules", "not significant") and p > 0.05
    better = [(1, 1)] * 50 + [(0, 1)] * 30 + [(1, 0)] * 5 + [(0, 0)] * 9
    method, why, p = routed(spark, better, two)
    assert (method, why) == ("TBM", "one pair") and p == pytest.approx(S.mcnemar_p(5, 30))
    for names in (two, three):
        agree = np.repeat(rng.integers(0, 2, (200, 1)), len(names), axis=1)
        assert routed(spark, agree, names)[:2] == ("rules", "not significant")
        for flat in (0, 1):
            assert routed(spark, [[flat] * len(names)] * 50, names) == ("rules", "no variance", None)
    assert routed(spark, [(0, 0, 1)] * 9 + [(0, 0, 0)] * 9, three) == ("rules", "few effective rows", None)
    assert routed(spark, [(0, 0, 1)] * 9, three) == (None, "excluded", None)
    method, why, p = routed(spark, rng.integers(0, 2, (200, 4)), four)
    assert (method, why) == ("rules", "not significant") and 0.05 < p < 1
    assert routed(spark, [(0, 1, 1, 0)] * 40 + [(1, 0, 0, 1)] * 4, four)[:2] == ("TBM", "vote")
    assert routed(spark, [(1,)] * 20 + [(0,)] * 20, ["rules"])[0] == "rules"


def test_quotas():
    """Rows and columns are exact, cells are shares rounded down or up, labels are near their shares."""
    rng = np.random.default_rng(1)
    for trial in range(12):
        names = [f"l{i}" for i in range(rng.integers(1, 9))]
        seen = {tuple(sorted(x for x in names if rng.random() < 0.35)): int(rng.integers(1, 60)) for _ in range(60)}
        sets = sorted(seen.items())
        folds = {f"f{i}": float(rng.integers(1, 9)) for i in range(rng.integers(2, 5))}
        got = X.quotas(sets, folds)
        n = np.array([c for _, c in sets])
        w = np.array([*folds.values()]) / sum(folds.values())
        assert (got.sum(axis=1) == n).all() and got.sum(axis=0).tolist() == X.shares(int(n.sum()), folds)
        assert (np.abs(got - np.outer(n, w)) < 2).all()
        for x in names:
            rows = [i for i, (ls, _) in enumerate(sets) if x in ls]
            assert (np.abs(got[rows].sum(axis=0) - n[rows].sum() * w) <= 1.5).all(), trial


def test_split_by_label_sets(spark, monkeypatch):
    monkeypatch.setattr(X, "RANKED", 50)
    rows = [(i, x) for i in range(3000) for x in (["a"] if i % 3 == 0 else []) + (["b"] if i % 7 < 2 else []) + (["c"] if i % 50 == 0 else []) or [None]] + [(5, "a"), (5, "a")]
    folds = {"train": 0.7, "dev": 0.1, "test": 0.2}
    df = spark.createDataFrame(rows, "doc_id long, label string")
    one = {r.doc_id: r.fold for r in X.split_by_label_sets(df.coalesce(1), folds).collect()}
    assert one == {r.doc_id: r.fold for r in X.split_by_label_sets(df.repartition(7), folds).collect()} and len(one) == 3000
    count = lambda keep: {f: sum(1 for d, x in one.items() if x == f and keep(d)) for f in folds}
    assert count(lambda d: True) == {"train": 2100, "dev": 300, "test": 600}
    for x in "abc":
        ids = {d for d, y in rows if y == x}
        got = count(lambda d: d in ids)
        assert all(abs(got[f] - len(ids) * w) <= 1 for f, w in folds.items())
    assert {r.doc_id: r.fold for r in X.split_by_label_sets(df, folds, seed=1).collect()} != one
    assert X.split_by_label_sets(df.where("false"), folds).count() == 0
    with pytest.raises(ValueError, match="distinct label sets"):
        X.split_by_label_sets(df, folds, max_sets=3)
    two = {r.fold: r["count"] for r in X.two_phase_split(df, 0.5, {"train": 0.8, "test": 0.2}).groupBy("fold").count().collect()}
    assert two == {"train": 1200, "test": 300, "unused": 1500}
