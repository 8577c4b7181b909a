"""Splits of documents that keep label shares, and random ones that grow with the data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stratify(docs: list[str], labels: list[set], folds: dict[str, float], seed: int = 42, repair: bool = True, sizes: bool = False, moves: int = 0, static: bool = False) -> dict[str, str]:
    """Iterative stratification: documents of the rarest label left go, one by one, to the fold that lacks it most.

    ``static``: labels are taken once, in the order of their document counts, instead of picking the rarest left anew.
    ``moves``: at most so many documents then go from a fold with too many of a label to one with too few of it, each the
    move that brings all label counts nearest to their shares; it ends early where none does.
    ``repair``: afterwards every fold gets a document of each label that has as many documents as folds.
    ``sizes``: then folds are brought to their sizes by moving the documents with most labels.
    """
    names, want = [*folds], {f: share / sum(folds.values()) for f, share in folds.items()}
    rng = np.random.default_rng(seed)
    order = [docs[i] for i in rng.permutation(len(docs))]
    has = dict(zip(docs, labels))
    room = {f: want[f] * len(docs) for f in names}
    need = {f: {} for f in names}
    left: dict = {}
    for d in docs:
        for x in has[d]:
            left.setdefault(x, set()).add(d)
    for x, ds in left.items():
        for f in names:
            need[f][x] = want[f] * len(ds)
    out: dict[str, str] = {}

    def put(d: str, f: str) -> None:
        out[d] = f
        room[f] -= 1
        for x in has[d]:
            need[f][x] -= 1
            left[x].discard(d)

    totals = {x: (len(ds), str(x)) for x, ds in left.items()}
    while open_ := {x: ds for x, ds in left.items() if ds}:
        rare = min(open_, key=lambda x: totals[x] if static else (len(open_[x]), str(x)))
        for d in [d for d in order if d in open_[rare]]:
            put(d, max(names, key=lambda f: (need[f][rare], sum(need[f][x] for x in has[d]), room[f], -names.index(f))))
    for d in order:
        if d not in out:
            put(d, max(names, key=lambda f: (room[f], -names.index(f))))
    members = lambda f, x: [d for d in order if out[d] == f and x in has[d]]
    if repair:
        for x in sorted({x for s in labels for x in s}, key=str):
            for f in names:
                if not members(f, x):
                    rich = max(names, key=lambda g: len(members(g, x)))
                    if len(ds := members(rich, x)) > 1:
                        out[min(ds, key=lambda d: (len(has[d]), d))] = f
    for _ in range(moves):
        if (best := _best_move(out, has, {x: n for x, (n, _) in totals.items()}, want, names)) is None:
            break
        out[best[0]] = best[1]
    if sizes:
        goal = {f: round(want[f] * len(docs)) for f in names}
        goal[names[0]] += len(docs) - sum(goal.values())
        count = {f: sum(v == f for v in out.values()) for f in names}
        while (high := max(names, key=lambda f: count[f] - goal[f])) and count[high] > goal[high]:
            low = min(names, key=lambda f: count[f] - goal[f])
            d = max((d for d in order if out[d] == high), key=lambda d: (len(has[d]), d))
            out[d], count[high], count[low] = low, count[high] - 1, count[low] + 1
    return out


def _best_move(out: dict, has: dict, totals: dict, want: dict, names: list[str]) -> tuple | None:
    """(document, fold): the move of one document that lowers the sum of label counts' distances from their shares most."""
    gap = {f: {x: -want[f] * n for x, n in totals.items()} for f in names}
    for d, f in out.items():
        for x in has[d]:
            gap[f][x] += 1
    best, kind = (-1e-9, ""), None
    seen = set()
    for d in sorted(out, key=str):
        src = out[d]
        if (src, frozenset(has[d])) in seen:  # documents of equal labels are alike
            continue
        seen.add((src, frozenset(has[d])))
        for f in names:
            if f != src:
                change = sum(abs(gap[src][x] - 1) - abs(gap[src][x]) + abs(gap[f][x] + 1) - abs(gap[f][x]) for x in has[d])
                if change < best[0]:
                    best, kind = (change, str(d)), (d, f)
    return kind


def stratified_split(doc_labels: DataFrame, folds: dict[str, float], seed: int = 42, repair: bool = True, sizes: bool = False, strata: int = 1, moves: int = 0, static: bool = False) -> DataFrame:
    """(doc_id, label) rows -> doc_id, fold.  Documents without a label have a row with a null label.

    The method is sequential: ``strata`` groups of documents, by hash of the id, are split each in a task of its own.
    Shares hold in each group, so they hold over all; which documents a fold gets changes with the number of groups.
    split_by_label_sets has no task that grows with the corpus.
    """
    rows = doc_labels.groupBy("doc_id").agg(F.collect_set("label").alias("labels")).withColumn("__g", F.pmod(F.xxhash64("doc_id"), F.lit(strata)))

    def split(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id")
        got = stratify(f.doc_id.tolist(), [set(x) for x in f.labels], folds, seed, repair, sizes, moves, static)
        return pd.DataFrame({"doc_id": f.doc_id, "fold": f.doc_id.map(got)})

    kind = dict(doc_labels.dtypes)["doc_id"]
    return rows.groupBy("__g").applyInPandas(split, f"doc_id {kind}, fold string")


def shares(total: int, folds: dict[str, float]) -> list[int]:
    """total dealt to folds in proportion: whole parts, then one more to those of the largest remainders, the first at ties."""
    want = [total * w / sum(folds.values()) for w in folds.values()]
    out = [int(np.floor(x + 1e-9)) for x in want]
    for f in sorted(range(len(want)), key=lambda f: (out[f] - want[f], f))[: total - sum(out)]:
        out[f] += 1
    return out


def quotas(sets: list[tuple[tuple[str, ...], int]], folds: dict[str, float], rounds: int = 10_000) -> np.ndarray:
    """How many documents of each label set (labels, count) each fold gets: rows sum to the counts, columns to shares() of all.

    A transportation problem with controlled rounding: each cell is its share rounded down or up.  What rounding leaves,
    less than a document a set and fold, is dealt so that labels' counts come near their shares: units go where they are
    most lacking, then single units move, and pairs of units change places, while that brings labels nearer.
    """
    n = np.array([c for _, c in sets], np.int64)
    w = np.array([*folds.values()], float)
    w /= w.sum()
    k = len(w)
    labels = sorted({x for ls, _ in sets for x in ls})
    at = {x: i for i, x in enumerate(labels)}
    has = np.zeros((len(sets), len(labels)))
    for i, (ls, _) in enumerate(sets):
        has[i, [at[x] for x in ls]] = 1
    size = np.array(shares(int(n.sum()), folds))
    want = np.outer(n, w)
    low = np.floor(want + 1e-9).astype(np.int64)
    unit = np.zeros_like(low)  # 1 where a cell is rounded up
    left, room = n - low.sum(axis=1), size - low.sum(axis=0)
    lack = has.T @ want - has.T @ low  # by label and fold: its share less what it has
    for s in sorted(np.flatnonzero(left), key=lambda s: (n[s], sets[s][0])):
        score = has[s] @ lack - (room <= 0) * 1e6 + (want[s] - low[s]) * 1e-3
        for f in np.argsort(-score, kind="stable")[: left[s]]:
            unit[s, f] += 1
            room[f] -= 1
            lack[:, f] -= has[s]

    def move(s: int, f: int, g: int) -> None:
        unit[s, f] -= 1
        unit[s, g] += 1
        room[f] += 1
        room[g] -= 1
        lack[:, f] += has[s]
        lack[:, g] -= has[s]

    def cost(f: int, g: int) -> np.ndarray:
        """By set: by how much the squared distances of labels change if a unit goes from f to g."""
        return 2 * has.sum(axis=1) + 2 * (has @ (lack[:, f] - lack[:, g]))

    while (room != 0).any():  # sizes first
        f, g = int(room.argmin()), int(room.argmax())
        can = np.flatnonzero((unit[:, f] > 0) & (unit[:, g] == 0))
        if not len(can):
            can = np.flatnonzero(low[:, f] + unit[:, f] > 0)
        move(int(can[cost(f, g)[can].argmin()]), f, g)
    for _ in range(rounds):
        best = (-1e-9, None)
        for f in range(k):
            for g in range(f + 1, k):
                there, back = (np.flatnonzero((unit[:, x] > 0) & (unit[:, y] == 0)) for x, y in ((f, g), (g, f)))
                if not len(there) or not len(back):
                    continue
                a, b = cost(f, g), cost(g, f)
                there, back = there[np.argsort(a[there], kind="stable")[:64]], back[np.argsort(b[back], kind="stable")[:64]]
                both = a[there][:, None] + b[back][None] - 4 * (has[there] @ has[back].T)
                i, j = np.unravel_index(both.argmin(), both.shape)
                if both[i, j] < best[0]:
                    best = (both[i, j], (int(there[i]), int(back[j]), f, g))
        if best[1] is None:
            break
        s, t, f, g = best[1]
        move(s, f, g)
        move(t, g, f)
    return low + unit


#: Documents of a label set that one window ranks, about; distinct label sets that the driver may hold.
RANKED, MAX_SETS = 10_000, 100_000


def split_by_label_sets(doc_labels: DataFrame, folds: dict[str, float], seed: int = 42, max_sets: int = MAX_SETS) -> DataFrame:
    """(doc_id, label) rows -> doc_id, fold.  Fold sizes are shares() of all documents; labels come near their shares (see quotas).

    Documents are counted by their set of labels; only the distinct sets, at most ``max_sets`` of them (more are an error),
    reach the driver, where fold quotas are solved.  Within a set documents go to folds by rank of a hash of the id.  A set is
    ranked in as many pieces of its hash range as its count needs, so no task grows with the corpus, and the result depends
    on ids, labels and seed alone.  A null label is none; documents without labels are a set of their own.
    """
    spark = doc_labels.sparkSession
    kind = dict(doc_labels.dtypes)["doc_id"]
    docs = doc_labels.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.col("label").cast("string"))).alias("__s"))
    counted = docs.groupBy("__s").agg(F.count("*").alias("n")).limit(max_sets + 1).collect()
    if len(counted) > max_sets:
        raise ValueError(f"more than {max_sets} distinct label sets")
    if not counted:
        return spark.createDataFrame([], f"doc_id {kind}, fold string")
    sets = sorted((tuple(r["__s"]), r.n) for r in counted)
    got = quotas(sets, folds)
    plan = [(list(ls), max(-(-n // RANKED), 1), *(int(x) for x in np.cumsum(q))) for (ls, n), q in zip(sets, got)]
    ends = [f"__e{i}" for i in range(len(folds))]
    plan = spark.createDataFrame(plan, "__s array<string>, __m long, " + ", ".join(f"{e} long" for e in ends))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11)  # 53 bits: exact in double precision
    d = docs.withColumn("__h", h).join(plan, "__s").withColumn("__p", F.least(F.floor(F.col("__h") / float(1 << 53) * F.col("__m")), F.col("__m") - 1))
    pieces = d.groupBy("__s", "__p").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("__s", "__p", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__b"))
    rank = F.row_number().over(Window.partitionBy("__s", "__p").orderBy("__h", "doc_id"))
    r = d.withColumn("__r", rank).join(before, ["__s", "__p"]).withColumn("__r", F.col("__r") + F.col("__b"))
    fold = F.lit(None).cast("string")
    for e, name in reversed([*zip(ends, folds)]):
        fold = F.when(F.col("__r") <= F.col(e), name).otherwise(fold)
    return r.select("doc_id", fold.alias("fold"))


def two_phase_split(doc_labels: DataFrame, keep: float, folds: dict[str, float], seed: int = 42) -> DataFrame:
    """First a stratified part of the corpus, then its folds; the rest is fold ``unused``."""
    first = split_by_label_sets(doc_labels, {"kept": keep, "unused": 1 - keep}, seed)
    kept = doc_labels.join(first.where("fold = 'kept'").select("doc_id"), "doc_id", "left_semi")
    return split_by_label_sets(kept, folds, seed + 1).unionByName(first.where("fold = 'unused'"))


def hash_split(docs: DataFrame, test: float = 0.2, seed: int = 42, id_col: str = "doc_id", names=("train", "test")) -> DataFrame:
    """A split by hash of the id: the same for a document in every run and at every size; no shuffle."""
    place = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) / 1_000_000.0
    return docs.withColumn("fold", F.when(place < test, names[1]).otherwise(names[0]))


def exact_split(docs: DataFrame, test: float = 0.1, seed: int = 42, id_col: str = "doc_id", names=("train", "dev"), buckets: int = 4096) -> DataFrame:
    """max(1, int(test * n)) documents of the least hash.

    The counts of ``buckets`` hash ranges find the range that holds the cut; only that range's rows are sorted.
    """
    h = F.xxhash64(F.lit(seed), id_col)
    b = F.shiftright(h, 52) + 2048 if buckets == 4096 else F.floor((h / 2.0**64 + 0.5) * buckets)
    counts = sorted(docs.groupBy(b.alias("b")).agg(F.count("*").alias("n")).collect())
    n = sum(r.n for r in counts)
    if not n:
        return docs.withColumn("fold", F.lit(names[0]))
    left, at = max(1, int(test * n)), None
    for r in counts:
        if left <= r.n:
            at = r.b
            break
        left -= r.n
    last = docs.where(b == at).select(h.alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(left).agg(F.max(F.struct("h", "i")).alias("c")).first().c
    return docs.withColumn("fold", F.when((h < last.h) | ((h == last.h) & (F.col(id_col) <= last.i)), names[1]).otherwise(names[0]))
