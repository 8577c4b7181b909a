"""Tests between methods: Friedman, Wilcoxon, paired t at document grain; Cochran, McNemar at mention grain."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions import stats as S


def score_matrix(scores: DataFrame, methods: list[str]) -> DataFrame:
    """scores (method, doc_id, label, tp, fp, fn) -> label, doc_id, f1_<method>; documents where no method counts anything are left out."""
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp").cast("double") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    s = scores.withColumns({"f1": f1, "n": F.col("tp") + F.col("fp") + F.col("fn")})
    w = s.groupBy("label", "doc_id").agg(*(F.max(F.when(F.col("method") == m, F.col("f1"))).alias(f"f1_{m}") for m in methods), F.sum("n").alias("__n"))
    return w.where("__n > 0").drop("__n").na.fill(0.0)


def friedman(matrix: DataFrame, methods: list[str]) -> DataFrame:
    """label, n_docs, mean per method, chi2 and p for three methods or more (1 where nothing varies); p is null for two.

    Ranks within a row are averaged over ties, row by row, without any window.
    """
    k = len(methods)
    cols = [F.col(f"f1_{m}") for m in methods]
    rank = [sum(((o < c).cast("double") + 0.5 * (o == c).cast("double") for j, o in enumerate(cols) if j != i), F.lit(1.0)) for i, c in enumerate(cols)]
    ties = sum((F.pow(sum(((o == c).cast("double") for o in cols), F.lit(0.0)), 2) - 1 for c in cols), F.lit(0.0))  # sum of t**3 - t over tie groups
    g = matrix.groupBy("label").agg(
        F.count("*").alias("n_docs"), *(F.avg(c).alias(f"mean_{m}") for c, m in zip(cols, methods)),
        *(F.sum(r).alias(f"__r{i}") for i, r in enumerate(rank)), F.sum(ties).alias("__t"),
    )
    n = F.col("n_docs")
    square = sum((F.pow(F.col(f"__r{i}"), 2) for i in range(k)), F.lit(0.0))
    c = 1 - F.col("__t") / (k * (k * k - 1) * n)
    chi2 = F.when(c > 0, (12.0 / (n * k * (k + 1)) * square - 3 * n * (k + 1)) / c)
    p = F.when(chi2.isNull(), 1.0).otherwise(S.chi2_sf(chi2, k - 1)) if k > 2 else F.lit(None).cast("double")
    return g.select("label", "n_docs", *(f"mean_{m}" for m in methods), chi2.alias("chi2"), p.alias("p"))


def excluded_counts(scores: DataFrame) -> DataFrame:
    """label, n_excluded: documents in which no method counts anything, of every label that scores names."""
    s = scores.groupBy("label", "doc_id").agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn")).alias("n"))
    return s.groupBy("label").agg(F.sum((F.col("n") == 0).cast("long")).alias("n_excluded"))


def sparsity(matrix: DataFrame, methods: list[str]) -> DataFrame:
    """label, sparsity: the share of documents where every method's F1 is 0."""
    nothing = sum((F.col(f"f1_{m}") for m in methods[1:]), F.col(f"f1_{methods[0]}")) == 0
    return matrix.groupBy("label").agg(F.avg(nothing.cast("double")).alias("sparsity"))


def significant_labels(tested: DataFrame, n: str = "n_docs", alpha: float = 0.05, least: int = 10) -> DataFrame:
    """Rows of labels with at least ``least`` rows and p up to alpha."""
    return tested.where((F.col(n) >= least) & F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") <= alpha))


def _differences(matrix: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """label, a, b, d, n: how often each difference of scores occurs; one pass for all pairs, combined before the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(f"f1_{a}") - F.col(f"f1_{b}")).alias("d")) for a, b in pairs)))
    rows = matrix.select("label", each.alias("x")).select("label", "x.*")
    return rows.groupBy("label", "a", "b", "d").agg(F.count("*").alias("n"))


def paired_tests(matrix: DataFrame, methods: list[str], alpha: float = 0.05) -> DataFrame:
    """Per label and pair of methods: Shapiro-Wilk on all differences, then paired t or Wilcoxon; n, test, statistic, p, winner.

    The winner has the higher mean; the second of the pair at ties.  A task holds the distinct differences of one label
    and pair with their counts, so its size is that of the distinct scores, whatever the number of documents, and the
    result does not depend on their order.
    """

    def test(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("d")
        d, n = f.d.to_numpy(float), f.n.to_numpy()
        _, normal = S.shapiro(d, n)
        name, (stat, p) = ("t", S.paired_t_of(d, n)) if normal > alpha else ("wilcoxon", S.wilcoxon_of(d, n))
        return pd.DataFrame([(f.label.iloc[0], f.a.iloc[0], f.b.iloc[0], int(n.sum()), name, stat, p, f.a.iloc[0] if (d * n).sum() > 0 else f.b.iloc[0])], columns=["label", "a", "b", "n", "test", "statistic", "p", "winner"])

    counted = _differences(matrix, [*combinations(methods, 2)])
    return counted.groupBy("label", "a", "b").applyInPandas(test, "label string, a string, b string, n long, test string, statistic double, p double, winner string")


def _summed(counted: DataFrame, value: str, out: str) -> DataFrame:
    """label, n, ``out``: an array of (v, n), each distinct value with its count, ascending, so that sums have one order."""
    return counted.groupBy("label").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), "n"))).alias(out))


def _fold(pairs: Column, term) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + term(x["v"]) * x["n"].cast("double"))


def mean_scores(matrix: DataFrame, methods: list[str]) -> DataFrame:
    """label, n_docs, mean_<method>: sums over distinct scores in ascending order, so the last digit does not depend on the partitioning."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"f1_{m}").alias("v")) for i, m in enumerate(methods))))
    counted = matrix.select("label", each.alias("x")).groupBy("label", "x.i", "x.v").agg(F.count("*").alias("n"))
    of = lambda i: F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("v", "n"))))
    g = counted.groupBy("label").agg(F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n_docs"), *(of(i).alias(f"__{i}") for i in range(len(methods))))
    return g.select("label", "n_docs", *((_fold(F.col(f"__{i}"), lambda v: v) / F.col("n_docs")).alias(f"mean_{m}") for i, m in enumerate(methods)))


def paired_t_statistic(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """label, n, t over the distinct differences in ascending order; t is null where they do not vary."""
    s = _summed(_differences(matrix, [(a, b)]), "d", "__d")
    s = s.withColumn("__m", _fold(F.col("__d"), lambda v: v) / F.col("n"))
    s = s.withColumn("__s", _fold(F.col("__d"), lambda v: (v - F.col("__m")) * (v - F.col("__m"))))
    return s.select("label", "n", F.when((F.col("n") > 1) & (F.col("__s") > 0), F.col("__m") / F.sqrt(F.col("__s") / (F.col("n") - 1) / F.col("n"))).alias("t"))


def signed_rank_statistic(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """min(W+, W-) per label, zeros dropped, ranks averaged over ties.

    Ranks run over distinct absolute differences with their counts, not over documents.
    """
    d = _differences(matrix, [(a, b)]).where("d <> 0")
    sign = lambda up: F.sum(F.when((F.col("d") > 0) == up, F.col("n")).otherwise(0))
    g = d.groupBy("label", F.abs("d").alias("size")).agg(sign(True).alias("up"), sign(False).alias("down"))
    both = F.col("up") + F.col("down")
    before = F.sum(both).over(Window.partitionBy("label").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    ranked = g.withColumn("r", F.coalesce(before, F.lit(0)) + (both + 1) / 2)
    return ranked.groupBy("label").agg(F.sum(both).alias("n"), F.least(F.sum(F.col("up") * F.col("r")), F.sum(F.col("down") * F.col("r"))).alias("w"))


def cochran(flags: DataFrame, methods: list[str]) -> DataFrame:
    """Detections (label, one 0/1 column per method) -> label, n, recalls, n_effective, hits, q, p.

    Rows without a hit are left out of q.  q and p are null where nothing varies between methods.
    """
    k = len(methods)
    cols = [F.col(m).cast("long") for m in methods]
    row = sum(cols[1:], cols[0])
    g = flags.groupBy("label").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(f"hits_{m}") for c, m in zip(cols, methods)),
        F.sum((row > 0).cast("long")).alias("n_effective"), F.sum(row).alias("__n"), F.sum(row * row).alias("__rr"),
    )
    cc = sum((F.col(f"hits_{m}") * F.col(f"hits_{m}") for m in methods[1:]), F.col(f"hits_{methods[0]}") * F.col(f"hits_{methods[0]}"))
    den = k * F.col("__n") - F.col("__rr")
    q = F.when(den > 0, ((k - 1) * (k * cc - F.col("__n") * F.col("__n"))).cast("double") / den)
    p = S.chi2_sf(q, k - 1) if k > 1 else F.lit(None).cast("double")
    return g.select("label", "n", *(f"hits_{m}" for m in methods), *((F.col(f"hits_{m}") / F.col("n")).alias(f"recall_{m}") for m in methods), "n_effective", q.alias("q"), p.alias("p"))


def contingency(flags: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """n11, n10, n01, n00 per label and pair of 0/1 columns, over rows as given; one pass for all pairs."""
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y")) for a, b in pairs)))
    r = flags.select("label", each.alias("e")).select("label", "e.*")
    n = lambda x, y: F.sum(((F.col("x") == x) & (F.col("y") == y)).cast("long"))
    return r.groupBy("label", "a", "b").agg(n(1, 1).alias("n11"), n(1, 0).alias("n10"), n(0, 1).alias("n01"), n(0, 0).alias("n00"))


def mcnemar(flags: DataFrame, methods: list[str], alpha: float = 0.05) -> DataFrame:
    """Contingency rows of every pair with p and Bonferroni significance; the winner has more hits, the first at ties."""
    pairs = [*combinations(methods, 2)]
    hit = sum((F.col(m).cast("int") for m in methods[1:]), F.col(methods[0]).cast("int")) > 0
    c = contingency(flags.where(hit), pairs)
    p = S.mcnemar(F.col("n10"), F.col("n01"))
    return c.withColumn("p", p).withColumns({"significant": F.col("p") <= alpha / len(pairs), "winner": F.when(F.col("n10") >= F.col("n01"), F.col("a")).otherwise(F.col("b"))})
