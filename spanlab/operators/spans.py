"""Span extraction, overlap arithmetic and overlap resolution."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions import text as T

METRICS = ("exact", "iou", "min", "gold", "pred")
DOC = ["doc_id"]
#: Matches that Python holds at once, beside one text and the batch it comes in.
BATCH = 1 << 15


def overlap_length(b1, e1, b2, e2) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(b1, b2))


def overlaps(b1, e1, b2, e2) -> Column:
    """Half-open: touching spans are disjoint."""
    return (b1 < e2) & (b2 < e1)


def overlap_score(metric: str, gb, ge, pb, pe) -> Column:
    """exact, iou, min, gold or pred; spans of no length score 0."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    both, g, p = overlap_length(gb, ge, pb, pe).cast("double"), ge - gb, pe - pb
    if metric == "exact":
        score = ((gb == pb) & (ge == pe)).cast("double")
    else:
        score = both / {"iou": g + p - both, "min": F.least(g, p), "gold": g, "pred": p}[metric]
    return F.when((g > 0) & (p > 0), score).otherwise(0.0)


def compiled_rules(rules: list[tuple]) -> list[re.Pattern]:
    """Expressions of the rules (pattern, label, priority[, flags]) of extract_spans."""
    flags = [r[3] if len(r) > 3 and r[3] is not None else "iu" for r in rules]
    return [re.compile(r[0], sum({"i": re.I, "u": re.U, "x": re.X, "s": re.S, "m": re.M}[f] for f in set(x))) for r, x in zip(rules, flags)]


def bounds_of(rx: re.Pattern, text: str) -> np.ndarray:
    """begin and end of every match as two columns of numbers; the matches themselves are not held."""
    return np.fromiter(chain.from_iterable(m.span() for m in rx.finditer(text)), np.int32).reshape(-1, 2)


def extract_spans(docs: DataFrame, rules: list[tuple], text_col: str = "text", keep: list[str] = DOC) -> DataFrame:
    """Every non-empty match of every rule (pattern, label, priority[, flags]); offsets are code points.

    Flags: i, u, x, s, m; i and u where none are given.  Rules are compiled once in each worker.
    """
    names, priorities = pa.array([r[1] for r in rules], pa.string()), np.array([int(r[2]) for r in rules], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = compiled_rules(rules)
        for b in batches:
            bounds: list[int] = []  # begin, end, begin, end
            covered: list[str] = []
            found: list[int] = []  # text, rule, how many

            def made() -> pa.RecordBatch:
                at, rule, n = np.array(found, np.int64).reshape(-1, 3).T
                ends = np.array(bounds, np.int32).reshape(-1, 2)
                row, rule = pa.array(np.repeat(at, n)), np.repeat(rule, n)
                cols = [*(b.column(k).take(row) for k in range(len(keep))), names.take(pa.array(rule)), pa.array(ends[:, 0]), pa.array(ends[:, 1]), pa.array(covered, pa.string()), pa.array(priorities[rule])]
                for held in (bounds, covered, found):
                    held.clear()
                return pa.RecordBatch.from_arrays(cols, names=[*keep, "label", "begin", "end", "text", "priority"])

            for i, t in enumerate(b.column(len(keep))):  # one text at a time
                if t := t.as_py():
                    for k, rx in enumerate(compiled):
                        n = 0
                        for m in rx.finditer(t):
                            s, e = m.span()
                            if s < e:
                                bounds += (s, e)
                                covered.append(t[s:e])
                                n += 1
                                if len(covered) >= BATCH:
                                    found += (i, k, n)
                                    n = 0
                                    yield made()
                        if n:
                            found += (i, k, n)
            if covered:
                yield made()

    kept = docs.select(*keep, text_col)
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.select(*keep).dtypes) + ", label string, begin int, end int, text string, priority int"
    return kept.mapInArrow(run, schema)


def extract_findings(docs: DataFrame, rules: list[tuple], text_col: str = "text", keep: list[str] = DOC) -> DataFrame:
    """extract_spans with verbose patterns, without the matches that functions.text.rejected names."""
    rules = [(r[0], r[1], r[2] if len(r) > 2 else 0, "iux") for r in rules]
    return extract_spans(docs, rules, text_col, keep).where(~T.rejected("text", "label"))


def emit_values(findings: DataFrame) -> DataFrame:
    """Findings of the markers HER2, FISH, ER, PR and Ki67 as (label, value) rows.

    A HER2 span gives its grade, its status, both or neither; FISH and receptors always give a value; Ki67 only with
    a number.
    """
    f = findings.withColumn("__n", T.normalized("text"))
    one = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    made = (
        F.when(F.col("label") == "HER2", F.array(one("HER2_IHC", T.ihc_value("__n")), one("HER2_status", T.status_value("__n"))))
        .when(F.col("label") == "FISH", F.array(one("HER2_FISH", T.fish_value("__n"))))
        .when(F.col("label") == "ER", F.array(one("Estrogen_receptor", T.receptor_value("__n"))))
        .when(F.col("label") == "PR", F.array(one("Progesterone_receptor", T.receptor_value("__n"))))
        .when(F.col("label") == "Ki67", F.array(one("Ki67", T.percent_value("text"))))
    )
    out = f.withColumn("__v", F.explode(F.filter(made, lambda x: x["value"].isNotNull())))
    return out.withColumns({"label": F.col("__v.label"), "value": F.col("__v.value")}).drop("__v", "__n")


def dedup_exact(spans: DataFrame, keys: list[str] = DOC) -> DataFrame:
    """One row of each (document, label, begin, end): that of the highest priority, then the least text."""
    w = Window.partitionBy(*keys, "label", "begin", "end").orderBy(F.desc_nulls_last("priority"), "text")
    return spans.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def together(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows with those of a key in one partition, sorted by the key and ``order``.

    They are dealt by a hash of the key, by which no join or union has dealt them before: Spark drops an exchange by columns that
    rows seem to be dealt by already, and adaptive execution over a union of joins then gave wrong matches.
    """
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def in_islands(rows: DataFrame, keys: list[str], begin: str, end: str, settle: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch], schema) -> DataFrame:
    """settle(rows, island, size) over rows in whole islands: rows of two islands never overlap.

    A key's rows come sorted by begin; an island ends where a row begins at or after all ends before it.  ``island`` numbers
    the islands of a call from 0, ``size`` says how many rows each row's island has, so rows that overlap no other are
    settled without a loop.  A task holds a batch and the island that is open at its end.
    """
    order = together(rows, keys, begin, end)
    at, b_at, e_at = [rows.columns.index(k) for k in keys], rows.columns.index(begin), rows.columns.index(end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last, far = None, None

        def settled(parts: list[pa.RecordBatch], new: np.ndarray) -> pa.RecordBatch:
            island = np.cumsum(new) - 1
            return settle(pa.Table.from_batches(parts).combine_chunks(), island, np.bincount(island)[island])

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            begins, ends = (b.column(c).to_numpy().astype(np.int64) for c in (b_at, e_at))
            change = np.zeros(n, bool)
            for k in at:
                x = b.column(k)
                same = pc.fill_null(pc.equal(x[1:], x[:-1]), False).to_numpy(zero_copy_only=False) | (pc.is_null(x[1:]).to_numpy(zero_copy_only=False) & pc.is_null(x[:-1]).to_numpy(zero_copy_only=False))
                change[1:] |= ~same
            first = tuple(b.column(k)[0].as_py() for k in at)
            goes_on = held and first == last
            group = np.cumsum(change) << 34
            reach = np.maximum.accumulate(ends + group)
            if goes_on:
                reach = np.maximum(reach, far)
            new = np.ones(n, bool)
            new[1:] = change[1:] | (begins[1:] + group[1:] >= reach[:-1])
            new[0] = not goes_on or begins[0] >= far
            cuts = np.flatnonzero(new)
            if len(cuts):
                if held:
                    parts = [*held, b.slice(0, cuts[0])] if cuts[0] else held
                    size = sum(x.num_rows for x in parts)
                    yield settled(parts, np.arange(size) == 0)
                if len(cuts) > 1:
                    yield settled([b.slice(cuts[0], cuts[-1] - cuts[0])], new[cuts[0] : cuts[-1]])
                held = [b.slice(cuts[-1])]
            else:
                held.append(b)
            last, far = tuple(b.column(k)[n - 1].as_py() for k in at), int(reach[-1] - group[-1])
        if held:
            yield settled(held, np.arange(sum(x.num_rows for x in held)) == 0)

    return order.mapInArrow(run, schema)


def _walked(at: list[tuple]) -> list[int]:
    """The rows that stay of sorted (island, order .., begin, end, row)."""
    stay, now, begins, ends = [], None, [], []
    for isle, *_, b, e, i in at:
        if isle != now:
            now, begins, ends = isle, [], []
        place = bisect.bisect_left(begins, e)  # kept rows before ``place`` begin before this one ends
        if not place or ends[place - 1] <= b:
            begins.insert(place, b)
            ends.insert(place, e)
            stay.append(i)
    return stay


def disjoint(order: list[np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """keep_disjoint within one document, over numbers: which spans stay."""
    by = np.lexsort((end, begin))
    new = np.ones(len(by), bool)
    new[1:] = begin[by][1:] >= np.maximum.accumulate(end[by])[:-1]
    island = np.cumsum(new) - 1
    several = np.bincount(island)[island] > 1
    crowd = by[several]
    keep = np.ones(len(by), bool)
    keep[crowd] = False
    keep[_walked(sorted(zip(island[several].tolist(), *(c[crowd].tolist() for c in (*order, begin, end)), crowd.tolist())))] = True
    return keep


def resolved_bounds(texts: list[str], compiled: list[re.Pattern], priority: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """extract_spans and resolve_overlaps within one document: begins, ends and rules' numbers.  rank: the rules' places by label."""
    found = [bounds_of(rx, t) for t in texts for rx in compiled]
    rule = np.repeat(np.arange(len(found)) % max(len(compiled), 1), [len(x) for x in found])
    b, e = np.concatenate([np.empty((0, 2), np.int32), *found]).T
    some = b < e
    b, e, rule = b[some], e[some], rule[some]
    stay = disjoint([-priority[rule], b - e, b, rank[rule]], b, e)
    return b[stay], e[stay], rule[stay]


def keep_disjoint(rows: DataFrame, keys: list[str], order: list[Column], begin: str = "begin", end: str = "end") -> DataFrame:
    """The rows that stay when each in turn, by order, is dropped if it overlaps one that has stayed.

    ``order`` has columns without nulls.  Islands are settled apart (see in_islands): a row that overlaps no other stays without
    further ado, the rows of another island are walked with the kept ones sorted, so n rows take n log n steps.
    """
    names = [f"__o{i}" for i in range(len(order))]
    marked, kept = rows.withColumns(dict(zip(names, order))), rows.columns

    def settle(t: pa.Table, island: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        keep = size == 1
        crowd = np.flatnonzero(~keep)
        if len(crowd):
            part = t.take(pa.array(crowd))
            at = sorted(zip(island[crowd].tolist(), *(part.column(c).to_pylist() for c in names), part.column(begin).to_pylist(), part.column(end).to_pylist(), crowd.tolist()))
            keep[_walked(at)] = True
        out = t.select(kept).filter(pa.array(keep)).combine_chunks()
        return out.to_batches()[0] if out.num_rows else pa.RecordBatch.from_pylist([], out.schema)

    return in_islands(marked, keys, begin, end, settle, rows.schema)


def resolve_overlaps(spans: DataFrame, keys: list[str] = DOC, mode: str = "suppress") -> DataFrame:
    """Greedy by priority, length (both descending), begin, label: a span stays if disjoint from all that stay (see keep_disjoint).

    mode ``keep_nested`` only drops exact repeats.
    """
    if mode == "keep_nested":
        return dedup_exact(spans, keys).select(*keys, "label", "begin", "end", "text", "priority")
    if mode != "suppress":
        raise ValueError(f"unknown mode {mode!r}")
    none = F.lit("")
    order = [F.coalesce(-F.col("priority"), F.lit(1 << 40)), F.col("begin") - F.col("end"), F.col("begin"), F.coalesce("label", none), F.coalesce("text", none)]
    return keep_disjoint(spans.select(*keys, "label", "begin", "end", "text", "priority"), keys, order)


def merge_adjacent(spans: DataFrame, keys: list[str] = DOC) -> DataFrame:
    """Spans by (begin, end, label): one of the same label that starts at or before the end of the span kept last extends it.

    Its score becomes the mean weighted by length.  Another label in between breaks a run.  Runs are found by windows;
    only the spans of one run meet in a row, whose score is folded once.
    """
    s = spans.select(*keys, "label", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), F.col("score").cast("double").alias("score"))
    w = Window.partitionBy(*keys).orderBy("begin", "end", "label", "score")
    s = s.withColumn("__s", F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(0))).withColumn("__s", F.sum("__s").over(w))
    streak = Window.partitionBy(*keys, "__s").orderBy("begin", "end", "score")
    far = F.max("end").over(streak.rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("__m", (F.col("begin") > far).cast("int")).withColumn("__m", F.sum(F.coalesce("__m", F.lit(0))).over(streak))
    runs = s.groupBy(*keys, "label", "__s", "__m").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "score"))).alias("__a"))

    def step(acc, x):
        w0, w1 = (acc["end"] - acc["begin"]).cast("double"), (x["end"] - x["begin"]).cast("double")
        score = F.when(w0 + w1 > 0, (acc["score"] * w0 + x["score"] * w1) / (w0 + w1)).otherwise(acc["score"])
        return F.struct(acc["begin"].alias("begin"), F.greatest(acc["end"], x["end"]).alias("end"), score.alias("score"))

    one = F.aggregate(F.slice("__a", 2, F.size("__a")), F.element_at("__a", 1), step)
    return runs.withColumn("__o", one).select(*keys, "label", "__o.begin", "__o.end", "__o.score")


def drop_nested(spans: DataFrame, keys: list[str] = DOC) -> DataFrame:
    """Spans that lie within another one of different bounds go, whatever the labels.

    Two windows instead of a self join: a span is nested if an earlier-or-equal begin reaches at least as far.
    """
    bounds = spans.select(*keys, "begin", "end").distinct()
    w = Window.partitionBy(*keys).orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    flat = bounds.withColumn("__far", F.max("end").over(w)).where(F.col("__far").isNull() | (F.col("__far") < F.col("end"))).drop("__far")
    return spans.join(flat, [*keys, "begin", "end"], "left_semi").select(*spans.columns)


def folded(text: str) -> str:
    """Lower case, code point by code point where a whole lower case would move offsets (İ has two code points)."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def find_occurrences(docs: DataFrame, text_col: str = "text", entity_col: str = "entity") -> DataFrame:
    """docs with one row per occurrence of entity in text, case-insensitive, overlapping ones too: begin, end.

    An empty entity occurs nowhere.  Only texts that hold the entity go to Python, which walks each once.
    """

    @F.pandas_udf("array<int>")
    def places(texts: pd.Series, entities: pd.Series) -> pd.Series:
        def one(text, entity):
            if text is None or not entity:
                return []
            low, ent, out = folded(text), folded(entity), []
            i = low.find(ent)
            while i >= 0:
                out.append(i)
                i = low.find(ent, i + 1)
            return out

        return pd.Series([one(t, e) for t, e in zip(texts, entities)], dtype=object)

    near = docs.where((F.length(entity_col) > 0) & F.contains(F.lower(text_col), F.lower(entity_col)))
    found = near.withColumn("begin", F.explode(places(F.col(text_col), F.col(entity_col))))
    return found.withColumn("end", F.col("begin") + F.length(entity_col))


def find_entities(docs: DataFrame, entities: DataFrame, keys: list[str] = DOC, text_col: str = "text", entity_col: str = "entity") -> DataFrame:
    """entities (keys, entity, more) with one row per occurrence in their document's text, as find_occurrences: begin, end.

    A document's text is read once, whatever the number of its entities: an automaton of all of them, with failure links,
    walks over it.  docs has a row a document; empty and null entities occur nowhere.
    """

    named = entities.where(F.length(entity_col) > 0)
    lists = named.groupBy(*keys).agg(F.array_sort(F.collect_set(entity_col)).alias("__e"))
    met = docs.select(*keys, F.col(text_col).alias("__t")).join(lists, keys).select(*keys, "__t", "__e")
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        built: dict[tuple, object] = {}

        def automaton(names: tuple):
            if names not in built:
                if len(built) > 256:
                    built.clear()
                a, at = ahocorasick.Automaton(), {}
                for i, x in enumerate(names):
                    at.setdefault(folded(x), []).append(i)
                for x, which in at.items():
                    a.add_word(x, (which, len(x)))
                a.make_automaton()
                built[names] = a
            return built[names]

        for b in batches:
            place: list[int] = []
            which: list[int] = []
            begins: list[int] = []
            lists = b.column(k + 1)

            def made() -> pa.RecordBatch:
                at = pa.array(place, pa.int32())
                name = lists.values.take(pa.array(which, pa.int64()))
                out = pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(k)), name, pa.array(begins, pa.int32())], names=[*keys, entity_col, "begin"])
                for held in (place, which, begins):
                    held.clear()
                return out

            first = lists.offsets.to_numpy()
            for i, text in enumerate(b.column(k)):  # one text at a time
                if not (text := text.as_py()):
                    continue
                for end, (names, n) in automaton(tuple(lists[i].as_py())).iter(folded(text)):
                    for x in names:
                        place.append(i)
                        which.append(int(first[i]) + x)
                        begins.append(end - n + 1)
                    if len(place) >= BATCH:
                        yield made()
            if place:
                yield made()

    kinds = ", ".join(f"`{c}` {t}" for c, t in met.select(*keys).dtypes)
    found = met.mapInArrow(run, f"{kinds}, `{entity_col}` string, begin int")
    return named.join(found, [*keys, entity_col]).withColumn("end", F.col("begin") + F.length(entity_col)).select(*entities.columns, "begin", "end")


def attach_attribute(spans: DataFrame, attributes: DataFrame, name: str, out: str, keys: list[str] = DOC) -> DataFrame:
    """spans with boolean ``out``: an attribute ``name`` is on the span and its value is not "false"."""
    # attributes that say "false" are as good as none; a task holds the others, once each, and spans pass by them unsorted
    said = (F.lower("name") == name.lower()) & (F.coalesce(F.lower("value"), F.lit("")) != "false")
    on = attributes.where(said).select(*keys, "tid").distinct().withColumn(out, F.lit(True)).hint("shuffle_hash")
    return spans.join(on, [*keys, "tid"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def resolve_relations(relations: DataFrame, spans: DataFrame, events: DataFrame | None = None, keys: list[str] = DOC) -> DataFrame:
    """Relations with both ends' spans; ends that name an event stand for its trigger; unresolved ones are dropped."""
    ends = spans.select(*keys, F.col("tid").alias("id"), F.struct("label", "begin", "end").alias("span"))
    if events is not None:
        ends = ends.unionByName(events.select(*keys, F.col("eid").alias("id"), F.col("trigger_tid").alias("tid")).join(spans.select(*keys, "tid", F.struct("label", "begin", "end").alias("span")), [*keys, "tid"]).select(*keys, "id", "span"))
    head = ends.select(*keys, F.col("id").alias("arg1"), F.col("span").alias("head"))
    tail = ends.select(*keys, F.col("id").alias("arg2"), F.col("span").alias("tail"))
    return relations.join(head, [*keys, "arg1"]).join(tail, [*keys, "arg2"]).select(*keys, "type", "head", "tail")
