"""Document fingerprints by winnowing, with DataFrame functions only.

Tokens are words: runs of at most 16 code points that are not white space.  In longer runs (long URLs, Thai, base64) each
code point is a token of its own, as ideographs, kana and hangul syllables always are, so where tokens are cut does not
depend on what stands before.  Hashes of k-grams of tokens come from doubling (the hash of 2m tokens from two neighbours of m), the
least of each window of w hashes from doubling too.  Hash and position share one long, hash first and position
descending, so the least value of a window is its rightmost least hash, and the position is kept.

Guarantee: two texts that share a run of w + k - 1 tokens share a selected hash, at known positions in both.  A text of
fewer than k tokens has the hash of all of them; fewer than w grams make one window; no token, an empty fingerprint.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K_LOG2, W_LOG2 = 2, 3
K, W = 1 << K_LOG2, 1 << W_LOG2
#: Code points that are tokens of their own, and those that are no word's.
SINGLE = "⺀-鿿가-힯"
BREAK = rf"\x20\x09-\x0D{SINGLE}"
TOKEN = rf"[{SINGLE}]|(?<![^{BREAK}])[^{BREAK}]{{1,16}}+(?![^{BREAK}])|[^{BREAK}]"
POSITIONS = (1 << 31) - 1
#: Neighbours are looked up in so many ranges of ids a shuffle partition, and in at most MAX_RANGES.
RANGES, MAX_RANGES = 4, 4000


def let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _doubled(a: Column, step: int) -> Column:
    """Hashes of each element of a with the one step later; a single hash stays."""
    left = F.slice(a, 1, F.greatest(F.size(a) - step, F.least(F.size(a), F.lit(1))))
    return F.zip_with(left, _shifted(a, step), lambda x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(F.xxhash64(x, y)))


def _lower(a: Column, step: int) -> Column:
    """The lesser of each element of a and the one step later."""
    return F.zip_with(a, _shifted(a, step), lambda x, y: F.least(x, y))


def _grams(h: Column) -> Column:
    """Hashes of K neighbours."""
    for m in range(K_LOG2):
        h = let(h, partial(_after, _doubled, 1 << m))
    return h


def _after(f, step: int, a: Column) -> Column:
    return f(a, step)


def winnow(text: Column) -> Column:
    """array<long>: for each selected gram its hash's 32 bits << 31 | (2**31 - 1 - position), by position."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    short = lambda t: F.filter(F.array(F.xxhash64(t)), lambda x: F.size(t) > 0)
    grams = let(tokens, lambda t: F.when(F.size(t) < K, short(t)).otherwise(_grams(F.transform(t, lambda x: F.xxhash64(x)))))
    packed = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR((F.lit(POSITIONS) - i).cast("long")))

    def least(a: Column) -> Column:
        m = a
        for s in range(W_LOG2):
            m = let(m, partial(_after, _lower, 1 << s))
        return F.slice(m, 1, F.greatest(F.size(a) - (W - 1), F.least(F.size(a), F.lit(1))))

    return F.array_distinct(let(packed, least))


def selected(fp: Column) -> Column:
    """array<struct<hash long, pos long>> of a winnowed fingerprint."""
    return F.transform(fp, lambda x: F.struct(F.shiftright(x, 31).alias("hash"), (F.lit(POSITIONS) - x.bitwiseAND(F.lit(POSITIONS))).alias("pos")))


def digest(fp: Column) -> Column:
    """One string for a fingerprint: the digest of its hashes and positions."""
    return F.sha2(F.concat_ws(",", F.transform(fp, lambda x: F.hex(x))), 256)


def likeness(a: Column, b: Column) -> Column:
    """Shared selected hashes over all, 0 to 1; two empty fingerprints are alike."""
    hashes = lambda x: F.array_distinct(F.transform(x, lambda v: F.shiftright(v, 31)))
    both = let(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("n"), F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b")))
    return let(both, lambda s: F.when(s["a"] + s["b"] == 0, F.lit(1.0)).otherwise(s["n"] / (s["a"] + s["b"] - s["n"])))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id and ``selected array<struct<hash,pos>>`` per row; no shuffle.  Null text is empty."""
    return docs.select(id_col, selected(winnow(F.col(text_col))).alias("selected"))


def with_next(rows: DataFrame, order: str, tie: str, carry: list[str]) -> DataFrame:
    """rows with ``next_<c>`` of the row that follows by order descending (nulls last), then tie; after the last comes the first.

    Ids are cut into ranges of about equal numbers of rows.  A range is one window, and its first row is also a guest at
    the end of the range before it, so only ranges' bounds - at most MAX_RANGES values - reach the driver.
    """
    spark = rows.sparkSession
    n = min(RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_RANGES)
    cuts = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("q")).first().q or []
    cuts = sorted({*cuts})
    rank = F.when(F.col(order).isNull(), 0)
    for_row = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c <= F.col(order))) + 1 if cuts else F.lit(1)
    ranged = rows.withColumn("__range", rank.otherwise(for_row))
    first = F.max(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("o"), (-F.col(tie).cast("decimal(20,0)")).alias("t")))
    heads = sorted(ranged.groupBy("__range").agg(first.alias("head")).collect(), key=lambda r: -r[0])
    if not heads:
        return rows.select("*", *(F.col(c).alias(f"next_{c}") for c in carry))
    before = [heads[i - 1][0] for i in range(len(heads))]
    plan = spark.createDataFrame([(h[0], h.head.o, int(-h.head.t), b) for h, b in zip(heads, before)], f"__range int, __o {dict(rows.dtypes)[order]}, __t long, __to int")
    hit = (ranged["__range"] == plan["__range"]) & ranged[order].eqNullSafe(plan["__o"]) & (ranged[tie] == plan["__t"])
    both = ranged.join(F.broadcast(plan), hit, "left").select(ranged["*"], "__to")
    here = F.struct(F.col("__range").alias("range"), F.lit(False).alias("guest"))
    there = F.struct(F.col("__to").alias("range"), F.lit(True).alias("guest"))
    placed = both.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    w = Window.partitionBy("__at.range").orderBy("__at.guest", F.desc_nulls_last(order), tie)
    out = placed.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carry)).where("not __at.guest")
    return out.drop("__range", "__to", "__at")


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n/2) code points replaced by as many first ones (or all) of the
    next document, by descending id; after the last comes the first.  Null ids come last; equal ids are ordered by a
    hash of the text.  Null text is empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h"))
    rows = rows.withColumn("fp", winnow(F.col("t")))
    near = with_next(rows, "id", "h", ["t", "fp"])
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), F.length("t") - half), F.substring("next_t", F.lit(1), half))
    near = near.select("id", F.length("t").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("e")).withColumn("efp", winnow(F.col("e")))
    return near.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("e", 256).alias("edited_sha256"), digest(F.col("fp")).alias("fingerprint"),
        digest(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
