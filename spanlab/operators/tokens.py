"""Tokens, BIO tags and the ways between characters, tokens and sentences."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.operators.spans import compiled_rules, disjoint, find_entities, keep_disjoint, resolved_bounds, together

SEQ = ["doc_id"]
#: Tokens that Python holds at once, beside one text and the batch it comes in.
BATCH = 1 << 15
#: Words and single symbols.
PATTERN = r"\w+|[^\w\s]"


def tokenize(docs: DataFrame, text_col: str = "text", keep: list[str] = SEQ, pattern: str = PATTERN, strip: bool = False) -> DataFrame:
    """One row per token: keep, tok_id from 0, token, begin, end (code points, half open).  strip: offsets after trimming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(pattern)
        for b in batches:
            place: list[int] = []  # text, its first token's number, how many
            tokens: list[str] = []
            bounds: list[int] = []  # begin, end, begin, end

            def made() -> pa.RecordBatch:
                at, first, n = np.array(place, np.int64).reshape(-1, 3).T
                ids = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)
                row, ends = pa.array(np.repeat(at, n)), np.array(bounds, np.int32).reshape(-1, 2)
                cols = [*(b.column(k).take(row) for k in range(len(keep))), pa.array(ids, pa.int32()), pa.array(tokens, pa.string()), pa.array(ends[:, 0]), pa.array(ends[:, 1])]
                for held in (place, tokens, bounds):
                    held.clear()
                return pa.RecordBatch.from_arrays(cols, names=[*keep, "tok_id", "token", "begin", "end"])

            for i, t in enumerate(b.column(len(keep))):  # one text at a time
                if t := t.as_py():
                    t = t.strip() if strip else t
                    first = n = 0
                    for m in rx.finditer(t):
                        bounds += m.span()
                        tokens.append(m[0])
                        n += 1
                        if len(tokens) >= BATCH:
                            place += (i, first, n)
                            first, n = first + n, 0
                            yield made()
                    if n:
                        place += (i, first, n)
            if tokens:
                yield made()

    d = docs.select(*keep, text_col)
    return d.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in d.select(*keep).dtypes) + ", tok_id int, token string, begin int, end int")


def offsets_of(tokens: DataFrame, keys: list[str] = SEQ, order: str = "tok_id") -> DataFrame:
    """begin and end of each token in the text that joins them by one space.

    Lengths are taken before tokens are dealt by document, so a caller that needs no ``token`` shuffles none.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = tokens.withColumn("__n", F.length("token")).withColumn("end", F.sum("__n").over(w) + F.count("__n").over(w) - 1)
    return t.withColumn("begin", F.col("end") - F.col("__n")).drop("__n")


def _parts(tag: Column) -> tuple[Column, Column]:
    return F.substring(tag, 1, 1), F.substring(tag, 3, 1_000_000)


def bio_spans(tags: DataFrame, keys: list[str] = SEQ, order: list[str] = ["tok_id"], tag: str = "tag", gap: bool = False, min_score: float | None = None) -> DataFrame:  # noqa: B006
    """Spans of B-/I-/O tags: keys, label, first, last (token ids, inclusive), n and, where tags have it, the mean score.

    B starts a span, I goes on only after the same label, else it starts one, O ends.  With ``gap`` a token that begins
    after the end of the one before starts a span too (begin, end columns).
    """
    kind, label = _parts(F.col(tag))
    w = Window.partitionBy(*keys).orderBy(*order)
    t = tags.withColumns({"__k": kind, "__l": label, "__n": F.row_number().over(w)})
    before = lambda c: F.lag(c).over(w)
    follows = (before("__k") != "O") & (before("__l") == F.col("__l"))
    if gap:
        follows = follows & (F.col("begin") <= before("end"))
    start = (F.col("__k") == "B") | ((F.col("__k") == "I") & ~F.coalesce(follows, F.lit(False)))
    t = t.withColumn("__s", F.sum(start.cast("int")).over(w)).where("__k <> 'O'")
    cols = [F.min("__n").alias("__first"), F.max("__n").alias("__last"), F.count("*").alias("n")]
    if "score" in tags.columns:
        cols.append(F.avg("score").alias("score"))
    if gap:
        cols += [F.min("begin").alias("begin"), F.max("end").alias("end")]
    out = t.groupBy(*keys, "__s", F.col("__l").alias("label")).agg(*cols)
    out = out.withColumns({"first": (F.col("__first") - 1).cast("int"), "last": (F.col("__last") - 1).cast("int")}).drop("__s", "__first", "__last")
    return out.where(F.col("score") >= min_score) if min_score is not None else out


def bio_tags(tokens: DataFrame, spans: DataFrame, keys: list[str] = SEQ) -> DataFrame:
    """tokens with ``tag`` by token spans (first, last, label, ord): a later span overwrites; ones out of range are ignored."""
    size = tokens.groupBy(*keys).agg(F.max("tok_id").alias("__max"))
    ok = spans.join(size, keys).where("first >= 0 and first <= last and last <= __max")
    return _tagged(tokens, ok, keys)


def _tagged(tokens: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    each = spans.withColumn("tok_id", F.explode(F.sequence("first", "last")))
    one = each.groupBy(*keys, "tok_id").agg(F.max_by(F.concat(F.when(F.col("tok_id") == F.col("first"), "B-").otherwise("I-"), "label"), "ord").alias("tag"))
    return tokens.join(one, [*keys, "tok_id"], "left").withColumn("tag", F.coalesce("tag", F.lit("O")))


def bio_tags_longest(tokens: DataFrame, spans: DataFrame, keys: list[str] = SEQ) -> DataFrame:
    """tokens (begin, end) with ``tag`` by character spans, longest first; a span that meets a tagged token is skipped whole.

    Ties in length go by begin, label.  Only spans that compete for a token are walked one by one (see spans.keep_disjoint).
    """
    s = _placed(tokens, spans.select(*keys, "begin", "end", "label").distinct(), keys, _touching, "first int, last int")
    s = s.where("first <= last").withColumn("__past", F.col("last") + 1)
    kept = keep_disjoint(s, keys, [F.col("begin") - F.col("end"), F.col("begin"), F.coalesce("label", F.lit(""))], "first", "__past")
    # places come from the tokens, so none is out of range
    return _tagged(tokens, kept.select(*keys, "label", "first", "last", F.lit(0).alias("ord")), keys)


class _Around:
    """Tokens around spans' ends, as places in the sorted tokens: by binary search, as tokens do not overlap."""

    def __init__(self, b: np.ndarray, e: np.ndarray, p: np.ndarray, q: np.ndarray):
        self.n = len(b)
        self.at = np.searchsorted(b, p, "right") - 1  # the last that begins at or before the span's begin
        self.next = np.searchsorted(b, p, "left")  # the first that begins at or after it
        self.touch = np.searchsorted(e, p, "right")  # the first that ends after it
        self.before = np.searchsorted(b, q, "left") - 1  # the last that begins before the span's end
        self.done = np.searchsorted(e, q, "right") - 1  # the last that ends at or before it
        self.over = np.searchsorted(e, q, "left")  # the first that ends at or after it


def _of(a: np.ndarray, i: np.ndarray, none: int) -> np.ndarray:
    """a at places i; ``none`` where there is no such place."""
    ok = (i >= 0) & (i < len(a))
    return np.where(ok, a.take(i, mode="clip"), none) if len(a) else np.full(len(i), none)


FAR = 1 << 40


def _touching(b: np.ndarray, e: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[pa.Array]:
    x = _Around(b, e, p, q)
    ok = (x.touch <= x.before) & (x.n > 0)
    return [pa.array(_of(ids, i, 0), pa.int32(), mask=~ok) for i in (x.touch, x.before)]


def _holding(b: np.ndarray, e: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[pa.Array]:
    x = _Around(b, e, p, q)
    ok = (_of(e, x.at, -FAR) > p) & (_of(e, x.before, -FAR) >= q)
    return [pa.array(_of(ids, i, 0), pa.int32(), mask=~ok) for i in (x.at, x.before)]


#: What the cascade tries, one after the other.
HOW = pa.array(["strict", "expand", "contract", "overlap", "nearest"])


def _cascade(b: np.ndarray, e: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in HOW, first and last token of spans; of use only where there are tokens."""
    x = _Around(b, e, p, q)
    head, tail = _of(e, x.at, -FAR) > p, _of(e, x.before, -FAR) >= q
    strict = (_of(b, x.at, -FAR) == p) & (_of(e, x.before, -FAR) == q)
    cases = [strict, strict | (head & tail), x.next <= x.done, x.touch <= x.before]
    near = np.zeros(len(p), np.int64)
    if len(far := np.flatnonzero(~np.logical_or.reduce(cases))):
        around = [i[far] for i in (x.at, x.next, x.done, x.over)]
        off = np.stack([np.minimum(np.abs(_of(b, i, FAR * 4) - p[far]), np.abs(_of(e, i, FAR * 4) - q[far])) for i in around])
        who = np.stack([_of(ids.astype(np.int64), i, FAR) for i in around])
        near[far] = np.where(off == off.min(axis=0), who, FAR).min(axis=0)
    how, first, last = np.full(len(p), len(cases)), near, near
    for k, (i, j) in reversed([*enumerate(zip((x.at, x.at, x.next, x.touch), (x.before, x.before, x.done, x.before)))]):
        how, first, last = (np.where(cases[k], v, rest) for v, rest in ((k, how), (_of(ids, i, 0), first), (_of(ids, j, 0), last)))
    return how, first, last


def _cascaded(b: np.ndarray, e: np.ndarray, ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> list[pa.Array]:
    how, first, last = _cascade(b, e, ids, p, q)
    none = np.full(len(p), not len(b))
    return [HOW.take(pa.array(how, mask=none)), *(pa.array(np.where(none, 0, c), pa.int32(), mask=none) for c in (first, last))]


def _placed(tokens: DataFrame, spans: DataFrame, keys: list[str], place: Callable, columns: str) -> DataFrame:
    """spans with ``columns``, which place(begins, ends, ids, span begins, span ends) makes.

    A document is a row with the places of its tokens and its spans; keys that are null are alike.  So documents are dealt and
    sorted, not tokens, whose places are lists of numbers (20 bytes each).  Places are found by binary search.

    The key is a structure, by which no join or union has dealt the rows before (see spans.together).
    """
    key = F.struct(*(F.col(f"`{c}`") for c in keys)).alias("__k")
    whole = tokens.where(F.col("begin").isNotNull() & F.col("end").isNotNull() & F.col("tok_id").isNotNull())  # so the lists are of one length
    token = whole.select(key, F.col("begin").cast("long").alias("__b"), F.col("end").cast("long").alias("__e"), F.col("tok_id").cast("int").alias("__i"))
    span = spans.select(key, F.struct(*(F.col(f"`{c}`") for c in spans.columns)).alias("__row"))
    met = token.unionByName(span, allowMissingColumns=True).groupBy("__k").agg(*(F.collect_list(c).alias(c) for c in ("__row", "__b", "__e", "__i")))
    met = met.where(F.size("__row") > 0).drop("__k")
    made = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column(0)
            s_at, t_at = s.offsets.to_numpy(), batch.column(1).offsets.to_numpy()
            p, q = (s.values.field(c).to_numpy(zero_copy_only=False) for c in ("begin", "end"))
            begins, ends, ids = (batch.column(c).values.to_numpy() for c in (1, 2, 3))
            found = []
            for x, y, v, w in zip(s_at, s_at[1:], t_at, t_at[1:]):
                b, e, i = begins[v:w], ends[v:w], ids[v:w]
                if (b[1:] < b[:-1]).any():
                    order = np.argsort(b, kind="stable")
                    b, e, i = b[order], e[order], i[order]
                found.append(place(b, e, i, p[x:y], q[x:y]))
            rows = s.values.slice(s_at[0], s_at[-1] - s_at[0])
            yield pa.RecordBatch.from_arrays([rows, *(pa.concat_arrays(c) for c in zip(*found))], names=["__row", *made])

    out = met.mapInArrow(run, f"__row {met.schema['__row'].dataType.elementType.simpleString()}, {columns}")
    return out.select(*(F.col(f"__row.`{c}`").alias(c) for c in spans.columns), *made)


def to_token_span(tokens: DataFrame, spans: DataFrame, keys: list[str] = SEQ, cascade: bool = False) -> DataFrame:
    """spans with first and last token.  A document's tokens do not overlap, and their ids are in the order of their places.

    The tokens that hold the first and the last character; without both, null.  cascade: then the span's tokens
    wholly inside it, then those that overlap it, then the token nearest to it, as ``how`` tells.
    """
    if cascade:
        return _placed(tokens, spans, keys, _cascaded, "how string, first int, last int")
    return _placed(tokens, spans, keys, _holding, "first int, last int")


def to_char_span(spans: DataFrame, tokens: DataFrame, keys: list[str] = SEQ) -> DataFrame:
    """Token spans (first, last) with begin and end characters."""
    t = lambda i, c: tokens.select(*keys, F.col("tok_id").alias(i), F.col(c))
    return spans.join(t("first", "begin"), [*keys, "first"]).join(t("last", "end"), [*keys, "last"])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Key (Arrow scalars) and texts of one document after the other, from rows sorted by key whose last column is the text."""
    key: tuple = ()
    texts: list[str] = []
    for b in batches:
        *at, text = b.columns
        for i in range(b.num_rows):
            now = tuple(c[i] for c in at)
            if texts and now != key:
                yield key, texts
                texts = []
            key = now
            texts.append(text[i].as_py())
    if texts:
        yield key, texts


def _texts(docs: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Texts that are not empty, those of a key together: all that is shuffled for work on whole documents."""
    return together(docs.select(*keys, text_col).where(F.length(text_col) > 0), keys, text_col)


def _cut(text: str, piece: re.Pattern, edge: re.Pattern) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """tokenize's begins, ends and tokens of one text, a bounded number at once.

    Tokens and the white space between them (``piece``) are all of a text, so their lengths give the places.  A part ends
    before a character that is in no word (``edge``).
    """
    at = 0
    while at < len(text):
        stop = edge.search(text, at + BATCH)
        pieces = piece.findall(text, at, stop.start() if stop else len(text))
        size = np.fromiter(map(len, pieces), np.int32, len(pieces))
        end = at + np.cumsum(size, dtype=np.int32)
        at = int(end[-1])
        token = ~np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        yield (end - size)[token], end[token], [*compress(pieces, token)]


def _cutter() -> tuple[re.Pattern, re.Pattern]:
    return re.compile(rf"{PATTERN}|\s+"), re.compile(r"\W")


def _token_places(texts: list[str], cutter: tuple[re.Pattern, re.Pattern], words: list[pa.Array] | None = None) -> tuple[np.ndarray, tuple]:
    """Tokens of one document: their ids, and (begins, ends, ids) by begin.  ``words``: gets the tokens, text by text."""
    begins, ends, ids = ([np.empty(0, np.int32)] for _ in range(3))
    for t in texts:
        n = 0
        for b, e, w in _cut(t, *cutter):
            begins.append(b)
            ends.append(e)
            ids.append(np.arange(n, n + len(b), dtype=np.int32))
            n += len(b)
            if words is not None:
                words.append(pa.array(w, pa.string()))
    b, e, i = map(np.concatenate, (begins, ends, ids))
    if len(texts) == 1:
        return i, (b, e, i)
    order = np.argsort(b, kind="stable")
    return i, (b[order], e[order], i[order])


def _labels(rules: list[tuple]) -> tuple[list, np.ndarray, np.ndarray]:
    """Labels of rules, their priorities, and the labels' places in sorted order, null first."""
    labels, priority = [r[1] for r in rules], np.array([int(r[2]) for r in rules], np.int64)
    place = {x: i for i, x in enumerate(sorted(set(labels), key=lambda x: (x is not None, x or "")))}
    return labels, priority, np.array([place[x] for x in labels], np.int64)


def rule_samples(docs: DataFrame, rules: list[tuple], keys: list[str] = SEQ, text_col: str = "text") -> DataFrame:
    """keys, tokenized_text, ner (first, last, label) of every document that has a token; ner is null where a key is.

    What sinks.sample_json makes of tokenize, extract_spans, resolve_overlaps and to_token_span's cascade, a whole document at a
    time: its text is shuffled, neither its tokens nor its spans.  A task holds BATCH tokens or one document, as Arrow and numbers.
    """
    labels, priority, rank = _labels(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, compiled, names = _cutter(), compiled_rules(rules), pa.array(labels, pa.string())
        place: list[tuple] = []  # key, how many tokens, spans' firsts, lasts and rules
        words: list[pa.Array] = []
        held = 0

        def made() -> pa.RecordBatch:
            found, n, first, last, rule = zip(*place)
            at = np.cumsum([0, *map(len, first)], dtype=np.int32)
            ner = pa.StructArray.from_arrays([pa.array(np.concatenate(first), pa.int32()), pa.array(np.concatenate(last), pa.int32()), names.take(pa.array(np.concatenate(rule)))], ["first", "last", "label"])
            none = pa.array([not all(x.is_valid for x in k) for k in found])
            cols = [
                *(pa.array(c, c[0].type) for c in zip(*found)), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n], dtype=np.int32)), pa.concat_arrays(words)),
                pa.ListArray.from_arrays(pa.array(at), ner, mask=none),
            ]
            place.clear()
            words.clear()
            return pa.RecordBatch.from_arrays(cols, names=[*keys, "tokenized_text", "ner"])

        for key, texts in _documents(batches):
            cut: list[pa.Array] = []
            ids, (b, e, i) = _token_places(texts, cutter, cut)
            if not len(ids):
                continue
            p, q, rule = resolved_bounds(texts, compiled, priority, rank)
            _, first, last = _cascade(b, e, i, p, q)
            order = np.lexsort((rank[rule], last, first))
            place.append((key, len(ids), first[order], last[order], rule[order]))
            if len(texts) > 1:
                one = pa.table({"i": ids, "w": pa.concat_arrays(cut)})
                cut = [one["w"].combine_chunks().take(pc.sort_indices(one, sort_keys=[("i", "ascending"), ("w", "ascending")]))]
            words += cut
            held += len(ids)
            if held >= BATCH:
                held = 0
                yield made()
        if place:
            yield made()

    rows = _texts(docs, keys, text_col)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    return rows.mapInArrow(run, f"{kinds}, tokenized_text array<string>, ner array<struct<first:int,last:int,label:string>>")


def rule_tag_counts(docs: DataFrame, rules: list[tuple], keys: list[str] = SEQ, text_col: str = "text") -> DataFrame:
    """tag, n: how many tokens have each tag by tokenize, extract_spans, resolve_overlaps and bio_tags_longest; all O where a key is null.

    A whole document at a time, as rule_samples; a task sends a row a tag.
    """
    labels, priority, rank = _labels(rules)
    names, named = ["O", *(f"{x}-{label}" for label in labels for x in "BI")], np.array([x is not None for x in labels], bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, compiled = _cutter(), compiled_rules(rules)
        counts = np.zeros(len(names), np.int64)
        for key, texts in _documents(batches):
            ids, (b, e, i) = _token_places(texts, cutter)
            counts[0] += len(ids)
            if not len(ids) or not all(x.is_valid for x in key):
                continue
            p, q, rule = resolved_bounds(texts, compiled, priority, rank)
            x = _Around(b, e, p, q)
            first, last = _of(i, x.touch, 0), _of(i, x.before, 0)
            on = np.flatnonzero((x.touch <= x.before) & (first <= last))
            on = on[disjoint([(p - q)[on], p[on], rank[rule[on]]], first[on], last[on] + 1)]
            on = on[named[rule[on]]]
            upto = np.cumsum(np.concatenate([[0], np.bincount(ids)]))  # tokens of lesser ids; texts of one key share ids
            for part, n in ((1, upto[first[on] + 1] - upto[first[on]]), (2, upto[last[on] + 1] - upto[first[on] + 1])):
                np.add.at(counts, 2 * rule[on] + part, n)
                counts[0] -= n.sum()
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.string()), pa.array(counts[some])], names=["tag", "n"])

    return _texts(docs, keys, text_col).mapInArrow(run, "tag string, n long").groupBy("tag").agg(F.sum("n").alias("n"))


def find_in_tokens(tokens: DataFrame, entities: DataFrame, keys: list[str] = SEQ) -> DataFrame:
    """entities (keys, entity, more) with first and last token of each occurrence in the tokens joined by one space.

    An occurrence that begins or ends at a space is none.
    """
    t = offsets_of(tokens, keys).select(*keys, "tok_id", "token", "begin", "end")
    text = t.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list(F.struct("tok_id", "token"))).getField("token"), " ").alias("text"))
    found = to_token_span(t, find_entities(text, entities, keys), keys)
    return found.where("first <= last").drop("begin", "end")


def sentence_starts(tokens: DataFrame, docs: DataFrame, keys: list[str] = SEQ, text_col: str = "text") -> DataFrame:
    """tokens of the documents with ``sent_id``: a line break between two tokens ends a sentence.

    Line breaks and tokens are swept together by position, so a document of n tokens takes n log n steps.
    """

    @F.pandas_udf("array<int>")
    def breaks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [m.start() for m in re.finditer("\n", t)])

    inner = tokens.join(docs.select(*keys).distinct(), keys, "left_semi")
    lines = docs.where(F.contains(F.col(text_col), F.lit("\n"))).select(*keys, F.explode(breaks(F.col(text_col))).alias("__at"))
    both = inner.withColumn("__t", F.lit(1)).unionByName(lines.withColumn("__t", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.coalesce("begin", "__at"), F.desc("__t"), "tok_id")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    brk = F.coalesce(F.last("__at", ignorenulls=True).over(past) >= F.last("end", ignorenulls=True).over(past), F.lit(False))
    marked = both.withColumn("__b", F.when(F.col("__t") == 1, brk).otherwise(False).cast("int"))
    return marked.withColumn("sent_id", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).where("__t = 1").select(*tokens.columns, "sent_id")


def sentence_remap(spans: DataFrame, sentences: DataFrame, keys: list[str] = SEQ) -> DataFrame:
    """Token spans in the sentence (sent_id, s_first, s_last) that holds a strict majority of their tokens, clipped and local; without one, dropped.

    Both sides are dealt by a hash beside the key, so sentences that were multiplied where their documents lay are dealt anew, in
    partitions by their own size, and not sorted in those of the documents.
    """
    dealt = lambda rows: rows.withColumn("__h", F.xxhash64(*keys))
    j = dealt(spans).join(dealt(sentences), ["__h", *keys]).drop("__h").where("first <= s_last and s_first <= last")
    n = F.least("last", "s_last") - F.greatest("first", "s_first") + 1
    held = j.where(2 * n > F.col("last") - F.col("first") + 1)
    return held.withColumns({"local_first": F.greatest("first", "s_first") - F.col("s_first"), "local_last": F.least("last", "s_last") - F.col("s_first")}).drop("s_first", "s_last")


def windows(tokens: DataFrame, size: int = 512, stride: int = 50, keys: list[str] = SEQ) -> DataFrame:
    """Token windows for a model: w_id, w_first, w_last; neighbours share ``stride`` tokens."""
    n = tokens.groupBy(*keys).agg(F.max("tok_id").alias("__max"))
    step = size - stride
    last = F.greatest(F.ceil((F.col("__max") + 1 - size) / step), F.lit(0))
    out = n.withColumn("w_id", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    return out.select(*keys, "w_id", (F.col("w_id") * step).alias("w_first"), F.least(F.col("w_id") * step + size - 1, "__max").alias("w_last"))


def merge_windows(tags: DataFrame, keys: list[str] = SEQ, min_score: float = 0.0) -> DataFrame:
    """Tags of tokens in overlapping windows (w_id, tok_id, tag, score) -> one a token: the surest, of the first window at ties; O below min_score."""
    best = F.min_by(F.struct("tag", "score"), F.struct((-F.col("score")).alias("s"), F.col("w_id").alias("w")))
    one = tags.groupBy(*keys, "tok_id").agg(best.alias("__b"))
    return one.select(*keys, "tok_id", F.when(F.col("__b.score") < min_score, "O").otherwise(F.col("__b.tag")).alias("tag"), F.col("__b.score").alias("score"))


def align_subwords(pieces: DataFrame, keys: list[str] = SEQ, ignore: str = "-100", mode: str = "first") -> DataFrame:
    """Sub-word rows (word_id, tag, piece_id) with ``piece_tag``: later pieces of a word are ignored, or continue as I-."""
    w = Window.partitionBy(*keys, "word_id").orderBy("piece_id")
    first = F.row_number().over(w) == 1
    later = F.lit(ignore) if mode == "first" else F.regexp_replace("tag", "^B-", "I-")
    return pieces.withColumn("piece_tag", F.when(F.col("word_id").isNull(), ignore).when(first, F.col("tag")).otherwise(later))
