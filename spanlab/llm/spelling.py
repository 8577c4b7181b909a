"""Spelling variants: words that differ by one inserted, deleted or replaced code point, without listing pairs.

A word of L code points stands in L wildcard groups (position, prefix, suffix): the words of a group are those that differ
at that position alone.  It also stands in a group for each distinct word that deleting one of its code points makes, where
that word, if it is in the vocabulary, stands as ``self``.  A group keeps its size and its two most frequent words, so each
member knows how many near words the group gives it and which is the best that is not itself.  No group is larger than the
alphabet (for deletions: times the length), however common a word is.

Groups are named by sums of 96 bits in all, one pseudo-random number for each (place, code point), which are formed for all
positions of a word in time linear in its length; rows carry numbers, never words.  Ties between near words of a group are
settled by where and by what they first differ from the word: that order is that of the strings.

Null words are left out; a word's occurrences are rows.  No rows give no rows.  Texts and words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlab.llm.common import discard, materialize

#: The multipliers and shifts of the splitmix64 finalizer, and its increment.
MULTIPLIERS, SHIFTS, STEP = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB), (30, 27, 31), 0x9E3779B97F4A7C15
WILD = 1 << 21  # above every code point
#: The order key of a member: position and code point; bits that say which kind of group, and on which side of the word it sorts.
POINT_BITS, AFTER, WILDCARD, SELF = 21, 1 << 60, 1 << 61, -1
LATE = 1 << 31
#: Code points of words that are worked at a time, and rows of a batch.
POINTS, ROWS = 1 << 16, 1 << 16


def _number(at: np.ndarray, point: np.ndarray, seed: int) -> np.ndarray:
    """A pseudo-random 64-bit number of a place and a code point."""
    z = (at.astype(np.uint64) << np.uint64(22)) + point.astype(np.uint64) + np.uint64(1)
    z = z * np.uint64(STEP) + np.uint64(seed)
    for m, s in zip((*MULTIPLIERS, None), SHIFTS):
        z = z ^ (z >> np.uint64(s))
        if m:
            z = z * np.uint64(m)
    return z


def _members(words: list[str], wid: np.ndarray, n: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, check, wid, n, o) of every group that the words stand in."""
    size = np.array([len(w) for w in words])
    point = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    at = np.arange(len(point)) - first[of]
    last = at == size[of] - 1
    after = np.append(point[1:], -1)
    deleted = (last | (point != after)) & (size[of] > least)
    keys = []
    for seed in (1, 2):
        own, left = _number(at, point, seed), np.where(at > 0, _number(np.maximum(at - 1, 0), point, seed), np.uint64(0))
        total = np.add.reduceat(own, first)
        wild = total[of] - own + _number(at, np.full(len(at), WILD), seed)
        before = np.cumsum(own) - own
        before -= before[first][of]
        shifted = np.cumsum(left)
        rest = shifted[first + size - 1][of] - shifted
        keys.append((wild, (before + rest)[deleted], total))
    i, c = at[deleted], point[deleted]
    low = ~last[deleted] & (c < after[deleted])
    side = np.where(low, (i << POINT_BITS) | c, AFTER + (((LATE - i) << POINT_BITS) | c))
    for (key, check), whose, o in zip(zip(*keys), (of, of[deleted], np.arange(len(words))), (WILDCARD + ((at << POINT_BITS) | point), side, np.full(len(words), SELF))):
        yield key.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32), wid[whose], n[whose], o


def _groups(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, wid, n = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            s = 0
            while s < len(words):
                e, size = s, 0
                while e < len(words) and (size == 0 or size + len(words[e]) <= POINTS):
                    size, e = size + len(words[e]), e + 1
                for cols in _members(words[s:e], wid[s:e], n[s:e], least):
                    for k in range(0, len(cols[0]), ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + ROWS]) for c in cols], names=["key", "check", "wid", "n", "o"])
                s = e

    return run


def near_words(vocabulary: DataFrame, least: int = 7) -> DataFrame:
    """(word, wid, n), words of at least ``least`` code points, each once -> wid, n_near, best: the near word of largest n.

    best is an array of at most three (wid, n), the best by a replacement, a deletion and an insertion; rows without a near
    word are left out.
    """
    rows = vocabulary.select("word", "wid", "n").mapInArrow(_groups(least), "key long, check int, wid long, n long, o long")
    order = Window.partitionBy("key", "check").orderBy(F.desc("n"), "o")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = F.struct("wid", "n", "o")
    g = rows.withColumns({
        "size": F.count("*").over(whole), "top": F.first_value(one).over(whole), "next": F.nth_value(one, 2).over(whole),
        "self": F.max(F.when(F.col("o") == SELF, one)).over(whole),
    }).where("size > 1")
    other = F.when(F.col("top.wid") == F.col("wid"), F.col("next")).otherwise(F.col("top"))
    wildcard, own = F.col("o") >= WILDCARD, F.col("o") == SELF
    deletion = ~wildcard & ~own & F.col("self").isNotNull()
    g = g.where(wildcard | own | deletion).withColumns({"v": F.when(deletion, F.col("self")).otherwise(other), "kind": F.when(wildcard, 0).when(deletion, 1).otherwise(2)})
    # Where the near word sorts among others of its kind: those before the word by the first place that differs, then those after it by the last.
    at, point, size = F.shiftright(F.col("o") - WILDCARD, POINT_BITS), F.col("v.o") - WILDCARD, F.lit(1 << POINT_BITS)
    point = point - F.shiftright(point, POINT_BITS) * size
    replaced = F.when(F.col("v.o") < F.col("o"), at * size + point).otherwise(AFTER + (LATE - at) * size + point)
    late = F.col("o") >= AFTER
    place = F.shiftright(F.when(late, F.col("o") - AFTER).otherwise(F.col("o")), POINT_BITS)
    deleted = F.when(late, (LATE - place) * size).otherwise(AFTER + (LATE - place) * size)
    rank = F.when(F.col("kind") == 0, replaced).when(F.col("kind") == 1, deleted).otherwise(F.col("v.o"))
    g = g.select("wid", "kind", F.when(F.col("kind") == 1, F.lit(1).cast("long")).otherwise(F.col("size") - 1).alias("near"), F.struct((-F.col("v.n")).alias("m"), rank.alias("r"), F.col("v.wid").alias("wid")).alias("x"))
    best = [F.min(F.when(F.col("kind") == k, F.col("x"))) for k in range(3)]
    found = g.groupBy("wid").agg(F.sum("near").alias("n_near"), F.array(*best).alias("b"))
    return found.select("wid", "n_near", F.transform(F.filter("b", lambda x: x.isNotNull()), lambda x: F.struct(x["wid"].alias("wid"), (-x["m"]).alias("n"))).alias("best"))


def spelling_forms(words: DataFrame, word_col: str = "word", min_chars: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """Occurrences of words -> word, form, root, n, n_near, form_n: one row a word of min_chars and min_count.

    form is the near word of largest n (ties: the least string) if its n is ``ratio`` times the word's or more; root
    follows forms to the last.  n grows by ``ratio`` (2 at least) at each step, so chains are short: they are followed by doubling.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, so that forms make no rings")
    counted = words.select(F.col(word_col).alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    v = materialize(counted.withColumn("wid", F.monotonically_increasing_id()))
    near = materialize(near_words(v, min_chars))
    most = F.array_max(F.transform("best", lambda x: x["n"]))
    rich = near.join(v.select("wid", "n"), "wid").where(most >= ratio * F.col("n"))
    cand = rich.select("wid", F.explode(F.filter("best", lambda x: x["n"] == most)).alias("c")).select("wid", F.col("c.wid").alias("to"))
    named = cand.join(v.select(F.col("wid").alias("to"), F.col("word").alias("form"), F.col("n").alias("form_n")), "to")
    up = materialize(named.groupBy("wid").agg(F.min(F.struct("form", "form_n", "to")).alias("f")).select("wid", "f.*"))
    root, longest = up.select("wid", "to"), v.agg(F.max("n")).first()[0] or 0
    steps, reach = 0, min_count
    while (reach := reach * ratio) <= longest:  # no chain has more steps than this
        steps += 1
    jump = 1
    while jump < steps:
        before, root = root, materialize(root.join(root.select(F.col("wid").alias("to"), F.col("to").alias("far")), "to", "left").select("wid", F.coalesce("far", "to").alias("to")))
        if jump > 1:
            discard(before)
        jump *= 2
    ends = root.join(v.select(F.col("wid").alias("to"), F.col("word").alias("root")), "to").select("wid", "root")
    out = v.join(near.select("wid", "n_near"), "wid", "left").join(up.select("wid", "form", "form_n").join(ends, "wid"), "wid", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
