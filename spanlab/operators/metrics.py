"""Metrics of a label over its mentions: templeability, contextual risk, homogeneity, frequency, feasibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlab.functions import text as T

#: Words whose presence marks a status, and answers that name no entity.  AMBIGUOUS is a default of this
#: library, not the documented list of any corpus; pass a corpus's own list as ``ambiguous``.
STATUS_WORDS = "positif|négatif|amplifié|amplifie|negatif|positive|negative|detected|mutation"
AMBIGUOUS = ("positif", "negatif", "négatif", "positive", "negative", "pos", "neg", "+", "-", "++", "+++", "1+", "2+", "3+", "oui", "non", "yes", "no", "present", "absent", "score", "grade", "stade", "faible", "fort")


#: Column of ``counted`` mentions that says how often a value occurs.
TIMES = "times"


def counted(mentions: DataFrame) -> DataFrame:
    """label, value (trimmed), times: one scan of the mentions and one shuffle of their distinct values.

    Every metric takes mentions or this table; of this one, all metrics read the same shuffle.
    """
    if TIMES in mentions.columns:
        return mentions
    return mentions.groupBy("label", F.trim("value").alias("value")).agg(F.count("*").alias(TIMES))


def _top_share(values: DataFrame, value: Column, when: Column, name: str, k: int = 1) -> DataFrame:
    """The share of the k commonest among the mentions that ``when`` holds for; the condition is part of the sum, so that all metrics read one plan."""
    n = values.groupBy("label", value.alias("__v")).agg(F.sum(F.when(when, F.col(TIMES))).alias("__n")).where("__n is not null")
    w = Window.partitionBy("label").orderBy(F.desc("__n"), "__v")
    return n.withColumn("__r", F.row_number().over(w)).groupBy("label").agg((F.sum(F.when(F.col("__r") <= k, F.col("__n")).otherwise(0)) / F.sum("__n")).alias(name))


def _share(c: Column) -> Column:
    return F.sum(F.when(c, F.col(TIMES)).otherwise(0)) / F.sum(TIMES)


def templeability(mentions: DataFrame, compat: bool = False) -> DataFrame:
    """Te per label, over mentions (label, value): top-3 shape share, kinds of format found, and starts that agree.

    Te = min(0.7 * top3 + min(0.15 * formats, 0.4) + (0.1 if the commonest start has over 0.8), 1).
    """
    m = counted(mentions)
    v = F.col("value")
    flags = m.groupBy("label").agg(
        F.sum(TIMES).alias("count"),
        _share(F.contains(v, F.lit("%"))).alias("percent"), _share(v.rlike(r"[+\-]")).alias("sign"),
        _share(F.lower(v).rlike(r"score\s*:?\s*\d")).alias("score"), _share(F.lower(v).rlike(STATUS_WORDS)).alias("status"), _share(v.rlike(r">|<|\d+\s*-\s*\d+")).alias("range"),
    )
    top3 = _top_share(m, T.shape("value", compat), F.lit(True), "top3", 3)
    start = _top_share(m, F.substring("value", 1, 2), F.length("value") >= 2, "start")
    last = _top_share(m, F.substring("value", -1, 1), F.length("value") >= 1, "finish")
    j = flags.join(top3, "label").join(start, "label", "left").join(last, "label", "left").na.fill(0.0, ["start", "finish"])
    found = sum(((F.col(c) > t).cast("int") for c, t in (("sign", 0.5), ("score", 0.3), ("status", 0.4), ("range", 0.2), ("start", 0.5), ("finish", 0.5))), (F.col("percent") > 0.7).cast("int"))
    te = F.least(F.col("top3") * 0.7 + F.least(found * 0.15, F.lit(0.4)) + F.when(F.col("start") > 0.8, 0.1).otherwise(0.0), F.lit(1.0))
    return j.select("label", "count", "top3", "start", "finish", found.cast("long").alias("formats"), te.alias("te"))


def synonyms_of(label: Column, synonyms: dict[str, list[str]] | None = None) -> Column:
    """The label's parts, and the list of the first key that the label contains."""
    parts = F.split(F.lower(label), "_")
    pick = None
    for key, words in (synonyms or {}).items():
        here = F.contains(F.lower(label), F.lit(key.lower()))
        value = F.array(*(F.lit(w) for w in words))
        pick = F.when(here, value) if pick is None else pick.when(here, value)
    return F.filter(parts if pick is None else F.array_union(parts, F.coalesce(pick, F.array().cast("array<string>"))), lambda s: s != "")


def risk_flags(mentions: DataFrame, ambiguous=AMBIGUOUS, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """mentions (label, value) with polysemic, numeric, explicit, structured and at_risk."""
    m = mentions.withColumns({"__v": F.lower(F.trim("value")), "__s": synonyms_of(F.col("label"), synonyms)})
    m = m.withColumn("__c", T.alnum_clean("__v"))
    v = F.col("__v")
    listed = v.isin(*ambiguous) | F.col("__c").isin(*ambiguous)
    numeric = ~listed & T.is_numeric("__v")
    bare_score = ~listed & ~numeric & v.rlike(r"^score\s*:?\s*\d+\+?$") & ~F.array_contains("__s", "score")
    padded = F.concat(F.lit(" "), F.regexp_replace(v, r"[^\p{L}\p{N}_]", " "), F.lit(" "))
    word = lambda s: F.contains(padded, F.concat(F.lit(" "), s, F.lit(" ")))
    explicit = F.exists("__s", lambda s: F.when(F.length(s) <= 3, word(s)).otherwise(F.contains(v, s)))
    risk = (listed | numeric | bare_score) & ~explicit
    mixed = ~risk & ~explicit & v.rlike("[a-z]") & v.rlike("[0-9]") & (F.length(v) > 3) & ~v.rlike(r"^(score|grade|stade)\s*:?\s*\d")
    return m.withColumns({"polysemic": listed | bare_score, "numeric": numeric, "explicit": explicit, "structured": mixed, "at_risk": risk}).drop("__v", "__s", "__c")


def risk(mentions: DataFrame, ambiguous=AMBIGUOUS, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """R per label and the shares of the four kinds; the shares are counted before the explicit name overrides, and need not add up."""
    f = risk_flags(counted(mentions), ambiguous, synonyms)
    return f.groupBy("label").agg(F.sum(TIMES).alias("count"), _share(F.col("at_risk")).alias("r"), *(_share(F.col(c)).alias(f"{c}_ratio") for c in ("polysemic", "numeric", "explicit", "structured")))


def homogeneity(mentions: DataFrame) -> DataFrame:
    """He = (tokens - distinct tokens) / tokens per label, and its sigmoid.  Counts are combined per (label, token) first."""
    times = F.col(TIMES) if TIMES in mentions.columns else F.lit(1).cast("long")
    t = mentions.select("label", F.explode(T.tokens("value")).alias("token"), times.alias(TIMES)).groupBy("label", "token").agg(F.sum(TIMES).alias("n"))
    s = t.groupBy("label").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_unique"))
    he = (F.col("n_tokens") - F.col("n_unique")) / F.col("n_tokens")
    return s.select("label", "n_tokens", "n_unique", he.alias("he"), T.sigmoid(he).alias("he_score"))


def frequency(mentions: DataFrame, docs: DataFrame, text_col: str = "text", compat: bool = False) -> DataFrame:
    """Mentions of a label over all words of the documents.  compat: a mention counts twice."""
    words = docs.agg(F.sum(T.word_count(text_col)).alias("total_words"))
    times = F.sum(TIMES) if TIMES in mentions.columns else F.count("*")
    n = mentions.groupBy("label").agg((times * (2 if compat else 1)).alias("count"))
    return n.crossJoin(F.broadcast(words)).withColumn("freq", T.ratio("count", "total_words"))


def feasibility(files: DataFrame, threshold: int = 500) -> DataFrame:
    """Files (dir, priority, name): per directory all files and those no earlier one has; over the threshold in all, models can be trained."""
    first = files.groupBy("name").agg(F.min("priority").alias("__p"))
    new = files.join(first, "name").groupBy("dir", "priority").agg(F.countDistinct("name").alias("files"), F.countDistinct(F.when(F.col("priority") == F.col("__p"), F.col("name"))).alias("new_files"))
    total = first.agg(F.count("*").alias("total"))
    return new.crossJoin(F.broadcast(total)).withColumn("decision", F.when(F.col("total") > threshold, "fine-tune all").otherwise("not enough"))


def metric_table(te: DataFrame, r: DataFrame, he: DataFrame, freq: DataFrame, defaults=(0.0, 1.0, 0.0, 0.0)) -> DataFrame:
    """te, r, he, freq and count of every label that te has; what lacks gets its default."""
    j = te.select("label", "te").join(r.select("label", "r"), "label", "left").join(he.select("label", "he"), "label", "left").join(freq.select("label", "freq", "count"), "label", "left")
    d = dict(zip(("te", "r", "he", "freq"), defaults))
    return j.select("label", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in d.items()), F.coalesce("count", F.lit(0)).alias("count"))
