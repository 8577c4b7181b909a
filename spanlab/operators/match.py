"""Gold against predicted spans: exact bags and sets, greedy one-to-one matching by overlap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.operators.spans import in_islands, overlap_score

KEYS = ["doc_id", "label"]


def only_gold_documents(pred: DataFrame, gold_docs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Predictions in documents without gold are not counted."""
    return pred.join(gold_docs.select(doc).distinct(), doc, "left_semi")


def _bags(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct span with its counts on both sides; a union and one aggregation, so one shuffle."""
    at = [*keys, "begin", "end"]
    g = gold.select(*at, F.lit(1).alias("__g"), F.lit(0).alias("__p"))
    p = pred.select(*at, F.lit(0).alias("__g"), F.lit(1).alias("__p"))
    return g.unionByName(p).groupBy(*at).agg(F.sum("__g").alias("g"), F.sum("__p").alias("p"))


def match_bag(gold: DataFrame, pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """tp, fp, fn per key: tp is the sum of the lesser multiplicities."""
    b = _bags(gold, pred, keys)
    return b.groupBy(*keys).agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"))


def match_set(gold: DataFrame, pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """tp, fp, fn per key over distinct spans."""
    b = _bags(gold, pred, keys)
    n = lambda c: F.sum(c.cast("long"))
    return b.groupBy(*keys).agg(n((F.col("g") > 0) & (F.col("p") > 0)).alias("tp"), n((F.col("g") == 0)).alias("fp"), n((F.col("p") == 0)).alias("fn"))


#: Pairs of a key's spans, at most, that are looked at without bins.
FEW = 4096
#: Levels of the ladder of bins: the widest is 2**LEVELS times the narrowest.
LEVELS = 40


def _binned(spans: DataFrame, begin: str, end: str, width: int) -> DataFrame:
    """spans with the level and number of the one smallest bin, of widths width * 2**level, that holds them."""
    bin_of = lambda c: F.floor(F.greatest(c, F.lit(0)) / width)
    first, last = bin_of(F.col(begin)), bin_of(F.greatest(F.col(end) - 1, F.col(begin)))
    # the bits above the highest one in which both ends' bins differ are those of the bin that holds both
    level = F.when(first == last, 0).otherwise(F.length(F.bin(first.bitwiseXOR(last))))
    return spans.withColumn("__level", F.least(level, F.lit(LEVELS)).cast("int")).withColumn("__bin", F.call_function("shiftright", first, F.col("__level")))


def _met(g: DataFrame, p: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs that can overlap: keys of at most FEW pairs meet at once, the others by bins.

    Whether there are others is counted first, as the plan for them shuffles both sides several times more.
    """
    side = lambda df, a, b: df.select(*keys, F.lit(a).alias("__gn"), F.lit(b).alias("__pn"))
    sizes = side(g, 1, 0).unionByName(side(p, 0, 1)).groupBy(*keys).agg(F.sum("__gn").alias("__gn"), F.sum("__pn").alias("__pn"))
    crowded = sizes.where(F.col("__gn") * F.col("__pn") > FEW).select(*keys)
    if crowded.isEmpty():
        return g.join(p, keys)
    plain = g.join(crowded, keys, "left_anti").join(p, keys)
    return plain.unionByName(_near(g.join(crowded, keys, "left_semi"), p.join(crowded, keys, "left_semi"), keys, width))


def _near(g: DataFrame, p: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs (gb, ge, pb, pe and other columns) that can overlap: each span is in one bin, and bins of overlapping spans lie one in the other.

    A span looks in its own bin and in those above it, but only on levels where its document has spans of the other side.
    So a span is copied at most as often as the ladder has levels in use, and a long span beside many short ones is in one bin.
    """
    g, p = _binned(g, "gb", "ge", width), _binned(p, "pb", "pe", width)

    both = [c for c in (*g.columns, *p.columns) if c not in keys and not c.startswith("__")]
    side = lambda df, tag, name: df.select(*keys, F.lit(tag).alias("__tag"), F.col("__level").alias("__level"), F.col("__bin").alias("__bin"), F.struct(*(c for c in df.columns if c in both)).alias(name))
    # tag 1: predictions look for gold spans in their bins and above; tag 2: gold spans for predictions strictly above
    low = side(p, 1, "__p").unionByName(side(g, 2, "__g"), allowMissingColumns=True)
    high = side(g, 1, "__hg").unionByName(side(p, 2, "__hp"), allowMissingColumns=True)
    at = [*keys, "__tag"]
    used = high.groupBy(*at).agg(F.array_sort(F.collect_set("__level")).alias("__used"))
    above = F.filter("__used", lambda x: (x > F.col("__level")) | ((x == F.col("__level")) & (F.col("__tag") == 1)))
    up = low.join(used, at).withColumn("__up", F.explode(above))
    up = up.withColumn("__bin", F.call_function("shiftright", F.col("__bin"), F.col("__up") - F.col("__level"))).withColumn("__level", F.col("__up")).drop("__up", "__used")
    met = up.join(high, [*at, "__level", "__bin"]).withColumns({"__g": F.coalesce("__g", "__hg"), "__p": F.coalesce("__p", "__hp")})
    return met.select(*keys, *(F.col(f"__{'g' if c in g.columns else 'p'}.{c}").alias(c) for c in both))


def candidate_pairs(gold: DataFrame, pred: DataFrame, metric: str, threshold: float, keys: list[str] = KEYS, width: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of one key whose overlap scores at least threshold: keys, gb, ge, pb, pe, score, and ``carry`` of either side.

    Without ``width`` the spans of a key meet all others of it, which is right for documents of few spans.  With it
    those of crowded keys meet by bins of a doubling ladder whose narrowest are that wide (see _near), whatever their lengths.
    """
    g = gold.select(*keys, F.col("begin").alias("gb"), F.col("end").alias("ge"), *(c for c in carry if c in gold.columns))
    p = pred.select(*keys, F.col("begin").alias("pb"), F.col("end").alias("pe"), *(c for c in carry if c in pred.columns))
    near = _met(g, p, list(keys), width) if width else g.join(p, list(keys))
    near = near.where((F.col("gb") < F.col("pe")) & (F.col("pb") < F.col("ge")))
    score = overlap_score(metric, F.col("gb"), F.col("ge"), F.col("pb"), F.col("pe"))
    return near.withColumn("score", score).where(F.col("score") >= threshold).select(*keys, "gb", "ge", "pb", "pe", "score", *carry)


def _greedy(gold: DataFrame, pred: DataFrame, metric: str, threshold: float, keys: list[str], width: int | None, order: list) -> DataFrame:
    """tp, fp, fn per key: pairs at or above threshold in turn take as much as is left of both multiplicities.

    Pairs that share a span lie in one island of positions, so islands are settled apart (see spans.in_islands): those of one
    pair at once, the pairs of another one by one in the order given.
    """
    count = lambda df, n: df.groupBy(*keys, "begin", "end").agg(F.count("*").alias(n))
    pairs = candidate_pairs(count(gold, "gn"), count(pred, "pn"), metric, threshold, keys, width, ("gn", "pn"))
    pairs = pairs.withColumns({"__b": F.least("gb", "pb"), "__e": F.greatest("ge", "pe")} | {f"__o{i}": c for i, c in enumerate(order)})
    names = [f"__o{i}" for i in range(len(order))]

    def settle(t: pa.Table, island: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        took = np.minimum(t.column("gn").to_numpy(), t.column("pn").to_numpy())
        crowd = np.flatnonzero(size > 1)
        if len(crowd):
            part = t.take(pa.array(crowd))
            col = lambda c: part.column(c).to_pylist()
            now, left_g, left_p = None, {}, {}
            for isle, *_, gb, ge, pb, pe, gn, pn, i in sorted(zip(island[crowd].tolist(), *map(col, names), *map(col, ("gb", "ge", "pb", "pe", "gn", "pn")), crowd.tolist())):
                if isle != now:
                    now, left_g, left_p = isle, {}, {}
                k = min(left_g.get((gb, ge), gn), left_p.get((pb, pe), pn))
                left_g[gb, ge] = left_g.get((gb, ge), gn) - k
                left_p[pb, pe] = left_p.get((pb, pe), pn) - k
                took[i] = k
        return pa.RecordBatch.from_arrays([*(t.column(k).combine_chunks() for k in keys), pa.array(took)], names=[*keys, "tp"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*keys).dtypes)
    return _with_totals(gold, pred, in_islands(pairs, keys, "__b", "__e", settle, kinds + ", tp long"), keys)


def match_overlap(gold: DataFrame, pred: DataFrame, metric: str = "min", threshold: float = 0.8, keys: list[str] = KEYS, width: int | None = None) -> DataFrame:
    """tp, fp, fn per key by greedy one-to-one matching.

    Pairs at or above threshold are taken by score descending, then gold length, predicted length, gold begin,
    predicted begin; each takes as much as is left of both multiplicities.  ``exact`` is match_bag.  ``width``: see candidate_pairs.
    """
    if metric == "exact":
        return match_bag(gold, pred, keys)
    order = [-F.col("score"), F.col("ge") - F.col("gb"), F.col("pe") - F.col("pb"), F.col("gb"), F.col("pb")]
    return _greedy(gold, pred, metric, threshold, list(keys), width, order)


def match_first_fit(gold: DataFrame, pred: DataFrame, metric: str = "min", threshold: float = 0.8, keys: list[str] = KEYS, width: int | None = None) -> DataFrame:
    """tp, fp, fn per key: each prediction in order of (begin, end) takes the first gold span left that reaches threshold."""
    return _greedy(gold, pred, metric, threshold, list(keys), width, [F.col(c) for c in ("pb", "pe", "gb", "ge")])


def _with_totals(gold: DataFrame, pred: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    g = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("tp"))
    p = pred.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("p"), F.lit(0).cast("long").alias("tp"))
    t = hits.select(*keys, F.lit(0).alias("g"), F.lit(0).alias("p"), "tp")
    all_ = g.unionByName(p).unionByName(t).groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("g").alias("g"))
    return all_.select(*keys, "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))


def errors(gold: DataFrame, pred: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Spans on one side only: keys, begin, end, kind (FP or FN), n."""
    b = _bags(gold, pred, keys).where("g <> p")
    return b.select(*keys, "begin", "end", F.when(F.col("p") > F.col("g"), "FP").otherwise("FN").alias("kind"), F.abs(F.col("p") - F.col("g")).alias("n"))


def detections(gold: DataFrame, preds: dict[str, DataFrame]) -> DataFrame:
    """Distinct gold mentions with one 0/1 column per method."""
    at = ["label", "doc_id", "begin", "end"]
    out = gold.select(*at).distinct()
    for name, p in preds.items():
        out = out.join(p.select(*at).distinct().withColumn(name, F.lit(1)), at, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


MATCHERS: dict[str, Callable] = {"bag": match_bag, "set": match_set, "overlap": match_overlap, "first_fit": match_first_fit}
