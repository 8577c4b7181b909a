"""Which method a label gets: by significance with a cheapest-first tie-break, or by a threshold tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlab.model import FRUGAL
from spanlab.operators import significance as T

#: Thresholds of the tree.
TREE = {"te_high": 0.5, "he_high": 0.5, "r_low": 0.3, "te_mid": 0.2, "freq": 0.001, "count": 50, "r_transformer": 0.8, "r_llm": 0.6}


def cost(method: Column, order=FRUGAL) -> Column:
    """The place in the order of cost; 99 for others."""
    out = F.lit(99)
    for i, m in reversed([*enumerate(order)]):
        out = F.when(F.lower(method) == m.lower(), i).otherwise(out)
    return out


def cheapest(methods: Column, order=FRUGAL) -> Column:
    """The cheapest of an array of methods."""
    return F.array_min(F.transform(methods, lambda m: F.struct(cost(m, order).alias("c"), m.alias("m"))))["m"]


def vote(pairs: DataFrame, methods: list[str], order=FRUGAL) -> DataFrame:
    """Significant wins per label (label, winner, significant): the method with most, the cheapest at ties and without any."""
    wins = [F.sum(((F.col("winner") == m) & F.coalesce("significant", F.lit(False))).cast("int")).alias(f"wins_{m}") for m in methods]
    g = pairs.groupBy("label").agg(*wins)
    most = F.greatest(*(F.col(f"wins_{m}") for m in methods))
    tied = F.filter(F.array(*(F.when(F.col(f"wins_{m}") == most, F.lit(m)) for m in methods)), lambda m: m.isNotNull())
    return g.select("label", *(f"wins_{m}" for m in methods), cheapest(tied, order).alias("method"))


def route_documents(matrix: DataFrame, methods: list[str], alpha: float = 0.05, least: int = 10, order=FRUGAL) -> DataFrame:
    """label, n_docs, p, method, why: excluded under ``least`` documents; not significant -> cheapest; else by pairwise votes.

    Of two methods, p is that of the paired test between them, and the one with the higher mean wins; one method
    alone is taken as it is.  Pairs are held to alpha over the number of pairs.  A p that no test gives (nothing varies) counts as 1.
    """
    f = T.friedman(matrix, methods)
    pairs = T.paired_tests(matrix, methods, alpha)
    sure = F.when(F.isnan("p"), 1.0).otherwise(F.coalesce("p", F.lit(1.0)))
    pairs = pairs.withColumn("p", sure)
    n = max(len(methods) * (len(methods) - 1) // 2, 1)
    low = cheapest(F.array(*(F.lit(m) for m in methods)), order)
    if len(methods) < 3:
        j = f.drop("p").join(pairs.select("label", "p", F.col("winner").alias("__m")), "label", "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
    else:
        pairs = pairs.withColumn("significant", F.col("p") <= alpha / n)
        j = f.join(vote(pairs, methods, order).select("label", F.col("method").alias("__m")), "label", "left")
    few, same = F.col("n_docs") < least, F.col("p") > alpha
    return j.select("label", "n_docs", "p", F.when(few, F.lit(None)).when(same, low).otherwise(F.coalesce("__m", low)).alias("method"), F.when(few, "excluded").when(same, "not significant").otherwise("vote" if len(methods) > 2 else "paired test").alias("why"))


def route_mentions(flags: DataFrame, methods: list[str], alpha: float = 0.05, least: int = 10, order=FRUGAL, default: str = "rules") -> DataFrame:
    """label, n, q, p, method, why.

    Under ``least`` mentions a label is excluded (no method).  Else it gets the default where no flag differs from another
    ("no variance"), where fewer than ``least`` rows have a hit ("few effective rows"), and where p is above alpha or there is
    none ("not significant"): p is Cochran's for three methods or more, McNemar's for two, whose winner has more hits.
    Of three or more the method that wins most significant McNemar pairs is taken, the cheapest at ties ("vote"); without
    any it is the default ("no significant pair").  One method alone is taken as it is.
    """
    c = T.cochran(flags, methods)
    hits = sum((F.col(f"hits_{m}") for m in methods[1:]), F.col(f"hits_{methods[0]}"))
    few, flat, thin = F.col("n") < least, (hits == 0) | (hits == F.col("n") * len(methods)), F.col("n_effective") < least
    alone = F.lit(len(methods) == 1)
    if len(methods) > 1:
        pairs = T.mcnemar(flags, methods, alpha)
        v = vote(pairs, methods, order).join(pairs.groupBy("label").agg(F.max("significant").alias("__any"), F.min("p").alias("__p"), F.min("winner").alias("__w")), "label")
        j = c.join(v, "label", "left")
    else:
        j = c.withColumns({"method": F.lit(methods[0]), "__any": F.lit(True), "__p": F.lit(None).cast("double")})
    two = len(methods) == 2
    p = F.when(few | flat | thin, F.lit(None)).otherwise(F.col("__p") if two else F.col("p")).cast("double")
    same = ~alone & (F.coalesce(F.when(F.isnan(p), 1.0).otherwise(p), F.lit(1.0)) > alpha)
    none = ~alone & ~F.coalesce("__any", F.lit(False))
    why = F.when(few, "excluded").when(flat, "no variance").when(thin, "few effective rows").when(same, "not significant")
    why = why.otherwise("one pair") if two else why.when(none, "no significant pair").otherwise("vote")
    method = F.when(few, F.lit(None)).when(flat | thin | same | (F.lit(not two) & none), F.lit(default)).otherwise(F.col("__w") if two else F.col("method"))
    return j.select("label", "n", F.when(few | flat | thin | F.lit(two), F.lit(None)).otherwise(F.col("q")).alias("q"), p.alias("p"), method.alias("method"), why.alias("why"))


def decision_tree(metrics: DataFrame, t: dict | None = None) -> DataFrame:
    """metrics (label, te, he, r, freq, count) with ``method`` and ``trace``."""
    t = TREE | (t or {})
    te, he, r, freq, n = (F.col(c) for c in ("te", "he", "r", "freq", "count"))
    rules = (te > t["te_high"]) & (he > t["he_high"]) & (r < t["r_low"])
    light = (te > t["te_mid"]) & (te <= t["te_high"]) & (freq > t["freq"]) & (n > t["count"])
    model = (freq > t["freq"]) | (r < t["r_transformer"])
    llm = (r > t["r_llm"]) & (te < t["te_mid"])
    method = F.when(rules, "rules").when(light, "light ML").when(model, "transformer").when(llm, "LLM").otherwise("rules (default)")
    yes = lambda c, a, b: F.when(c, a).otherwise(b)
    trace = F.concat_ws(" -> ", yes(rules, "regular", "irregular"), F.when(~rules, yes(light, "learnable", "not learnable")), F.when(~rules & ~light, yes(model, "data or low risk", "rare and risky")), F.when(~rules & ~light & ~model, yes(llm, "needs context", "default")))
    return metrics.withColumns({"method": method, "trace": trace})


def run_summary(decisions: DataFrame, n: str, alpha: float = 0.05, least: int = 10) -> DataFrame:
    return decisions.agg(F.sum((F.col(n) >= least).cast("long")).alias("n_tested"), F.sum(((F.col(n) >= least) & F.coalesce(F.col("p") <= alpha, F.lit(False))).cast("long")).alias("n_significant"))
