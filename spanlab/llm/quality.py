"""Quality by hierarchical empirical Bayes: a document's own evidence, its host's and its path's posterior.

1. Evidence: a ridge logistic regression on features of the whole text gives p(good | text).  It is fitted on the
   driver from at most ``max_labelled`` labelled rows (those of the least id hash); its size does not grow.
2. Sites: one grouped aggregation sums evidence by (host, path).  Method-of-moments beta priors - the spread of host
   means around the global mean, and of path means around their hosts' - shrink sparse hosts toward the global mean
   and sparse paths toward their host.
3. Posterior: the document's likelihood ratio times the prior odds of its path, its own share left out; probabilities are
   held to 1e-9 and 1 - 1e-9 in odds.

Sums by site are combined before the shuffle; the table of sites joins back as the planner sees fit (broadcast by its
measured size, else a shuffled join that splits hot sites).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.common import materialize, working_names

#: Labelled rows that the evidence model is fitted on, at most.
MAX_LABELLED = 20_000
FEATURES = 14


def features(text: str | None) -> list[float]:
    """Features of a whole text; null is empty."""
    text = text or ""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    h = np.bincount(raw, minlength=256).astype(float)
    total = max(h.sum(), 1.0)
    share = h / total
    upper, lower, digits = share[65:91].sum(), share[97:123].sum(), share[48:58].sum()
    high, space = share[128:].sum(), share[32] + share[9:14].sum()
    seen = share[share > 0]
    counts = Counter(words)
    distinct = len(counts)
    again = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(n), len(text) / (n + 1), distinct / np.sqrt(n + 1), distinct / max(n, 1), max(counts.values(), default=0) / max(n, 1), again / max(n, 1),
        1 - upper - lower - digits - high - space, digits, upper, high, share[10], -(seen * np.log(seen)).sum(), share[35:38].sum() + share[42] + share[38] + share[64], float(n == 0),
    ]


class Evidence:
    """p(good | text); without labelled rows of both kinds it is one half for every text."""

    def __init__(self, mean=None, scale=None, weight=None):
        self.mean, self.scale, self.weight = mean, scale, weight

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> Evidence:
        if len(y) == 0 or y.min() == y.max():
            return cls()
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.clip((x - mean) / scale, -8, 8)
        z = np.hstack([z, z[:, :] ** 2, np.ones((len(z), 1))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = z.T @ (p - y) + penalty * w
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
            w = w - step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), 0.5)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.hstack([z, z**2, np.ones((len(z), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weight, -30, 30)))


def fit_evidence(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED) -> Evidence:
    """The evidence model from labelled documents; rows with a null id or label are left out.

    Where so many documents share labelled ids that they are more than twice ``max_labelled``, an arbitrary part of
    them, so many, is taken.
    """
    sample = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    sample = sample.orderBy(F.xxhash64("id"), "id", "y").limit(max_labelled)

    @F.pandas_udf("array<double>")
    def feats(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    got = rows.select(feats("text").alias("x"), "y").limit(2 * max_labelled).collect()
    return Evidence.fit(np.array([r.x for r in got], float).reshape(-1, FEATURES), np.array([r.y > 0.5 for r in got], float))


def site_strength(groups: DataFrame, mean, n: str, s: str) -> float:
    """The strength, in documents, of a beta prior for groups of n documents with evidence sum s around ``mean``."""
    within = mean * (1 - mean)
    r = groups.agg(
        F.sum(F.pow(F.col(s) / F.col(n) - mean, 2) * F.col(n)).alias("spread"), F.sum(within).alias("noise"),
        F.sum(within * F.col(n)).alias("within"), F.sum(n).alias("n"),
    ).first()
    if not r.n:
        return 1.0
    between = max((r.spread - r.noise) / r.n, 1e-6)
    return float(min(max(r.within / r.n / between - 1, 1.0), 1e6))


def score_documents(docs: DataFrame, model: Evidence, host, path, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs, all columns, with ``evidence, host_mean, path_mean, quality`` and ``keep``.

    ``host`` and ``path`` are columns or expressions; null is a value of its own.  Repeated rows each count.  Null
    and empty texts are scored as empty.  An empty table gives an empty one.  Columns of docs by these five names are
    replaced.  A row is kept where its quality is at least threshold.
    """

    @F.pandas_udf("double")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series(model.predict(np.array([features(t) for t in texts], float).reshape(-1, FEATURES)))

    made = ["evidence", "host_mean", "path_mean", "quality", "keep"]
    host = F.col(host) if isinstance(host, str) else host
    path = F.col(path) if isinstance(path, str) else path
    left = docs.drop(*made)
    h, q, p, n, t, hn, ht = working_names(docs, "__host", "__path", "__p", "__n", "__s", "__hn", "__hs")
    scored = docs.withColumns({h: F.coalesce(host.cast("string"), F.lit("\0")), q: F.coalesce(path.cast("string"), F.lit("\0"))}).drop(*made).withColumn(p, evidence(F.col(text_col)))
    paths = materialize(scored.groupBy(h, q).agg(F.count("*").alias(n), F.sum(p).alias(t)))
    g = paths.agg(F.sum(t), F.sum(n)).first()
    mean = g[0] / g[1] if g[1] else 0.5
    hosts = paths.groupBy(h).agg(F.sum(n).alias(hn), F.sum(t).alias(ht))
    k_host = site_strength(hosts, F.lit(mean), hn, ht)
    host_mean = (F.col(ht) + k_host * mean) / (F.col(hn) + k_host)
    sites = paths.join(hosts.select(h, host_mean.alias("host_mean")), h)
    k_path = site_strength(sites, F.col("host_mean"), n, t)
    out = scored.join(sites, [h, q])
    others = (F.col(t) - F.col(p) + k_path * F.col("host_mean")) / (F.col(n) - 1 + k_path)
    logit = lambda x: F.log(x / (1 - x))
    held = lambda x: F.greatest(F.least(x, F.lit(1 - 1e-9)), F.lit(1e-9))
    odds = logit(held(F.col(p))) + logit(held(others)) - logit(held(F.lit(mean)))
    out = out.withColumns({"evidence": F.col(p), "path_mean": others, "quality": 1 / (1 + F.exp(-odds))})
    return out.withColumn("keep", F.col("quality") >= threshold).select(*(f"`{c}`" for c in left.columns), *made)
