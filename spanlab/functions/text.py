"""Column functions over text: tokens, shapes, normal forms, value parsers, bands."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMERIC = r"^(<|>|<=|>=)?\s*\d+([.,]\d+)?\s*%?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text) -> Column:
    """Words between any Unicode white space."""
    return F.size(F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")).cast("long")


def tokens(text, lower: bool = True) -> Column:
    """Maximal runs of ASCII letters, digits and %; all else, accented letters too, separates."""
    words = F.regexp_extract_all(_c(text), F.lit("[a-zA-Z0-9%]+"), F.lit(0))
    return F.transform(words, lambda w: F.lower(w)) if lower else words


def token_strings(text) -> Column:
    """Unicode words and single symbols, without offsets (operators.tokens has them)."""
    return F.regexp_extract_all(_c(text), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def shape(text, compat: bool = False) -> Column:
    """Digits as D, capitals as X, small letters as x.  compat: the chained form, in which a digit ends as X too."""
    if not compat:
        return F.translate(_c(text), DIGITS + UPPER + LOWER, "D" * 10 + "X" * 26 + "x" * 26)
    out = F.regexp_replace(_c(text), "[0-9]", "D")
    return F.regexp_replace(F.regexp_replace(out, "[A-Z]", "X"), "[a-z]", "x")


#: Hangul syllables and the letters that they are made of: by the rule of composition, 19 leads, 21 vowels, 27 tails.
FIRST_SYLLABLE, LAST_SYLLABLE, LEADS, VOWELS, TAILS = "\uac00", "\ud7a3", 0x1100, 0x1161, 0x11A8


@lru_cache(maxsize=1)
def _bare_letters() -> tuple[str, str, dict[str, str]]:
    """Code points that lose marks, those that are marks coming last; the former's bare letters; those that come to several letters, Hangul apart."""
    marked, marks, bare, several = [], [], [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if "\ud800" <= c <= "\udfff" or FIRST_SYLLABLE <= c <= LAST_SYLLABLE:
            continue
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not plain:
            marks.append(c)
        elif len(plain) > 1:
            several[c] = plain
        elif plain != c:
            marked.append(c)
            bare.append(plain)
    return "".join(marked + marks), "".join(bare), several


def _taken_apart(text: Column, several: dict[str, str]) -> Column:
    """Hangul syllables and the code points of ``several`` as their letters."""
    part = lambda first, n, i: F.substring(F.lit("".join(map(chr, range(first, first + n)))), i.cast("int") + 1, F.lit(1))
    table = F.create_map(*(F.lit(x) for kv in several.items() for x in kv))

    def one(c: Column) -> Column:
        k = F.ascii(c) - ord(FIRST_SYLLABLE)
        tail = k % 28
        made = F.concat(part(LEADS, 19, F.floor(k / 588)), part(VOWELS, 21, F.floor(k % 588 / 28)), F.when(tail > 0, part(TAILS, 27, tail - 1)).otherwise(""))
        return F.when((c >= FIRST_SYLLABLE) & (c <= LAST_SYLLABLE), made).otherwise(F.coalesce(F.try_element_at(table, c), c))

    some = text.rlike(f"[{FIRST_SYLLABLE}-{LAST_SYLLABLE}{''.join(several)}]")
    return F.when(some, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def strip_accents(text) -> Column:
    """Canonical decomposition without its non-spacing marks, by native functions; ASCII texts are only measured.

    The tables of letters are made by rule from the interpreter's Unicode data.  Marks that take space keep their order.
    """
    t = _c(text)
    marked, bare, several = _bare_letters()
    apart = _taken_apart(t, several)
    return F.when(F.length(t) == F.octet_length(t), t).otherwise(F.translate(apart, marked, bare))


def same_text(a, b) -> Column:
    """Whether two texts are equal but for case and accents, by Spark's collation."""
    return F.collate(_c(a), "UNICODE_CI_AI") == F.collate(_c(b), "UNICODE_CI_AI")


def normalized(text) -> Column:
    """Lower case, no accents, single spaces, trimmed."""
    return F.trim(F.regexp_replace(strip_accents(F.lower(_c(text))), r"(?U)\s+", " "))


def alnum_clean(text) -> Column:
    return F.regexp_replace(_c(text), r"[^a-z0-9+\-%]", "")


def is_numeric(text) -> Column:
    return _c(text).rlike(NUMERIC)


def sigmoid(x, steepness: float = 10.0, middle: float = 0.5) -> Column:
    return 1 / (1 + F.exp(-F.lit(steepness) * (_c(x) - middle)))


def ratio(num, den) -> Column:
    """num / den as double; 0 where den is 0."""
    return F.when(_c(den) > 0, _c(num).cast("double") / _c(den)).otherwise(0.0)


def prf(tp="tp", fp="fp", fn="fn") -> list[Column]:
    """precision, recall and f1; zero denominators give 0."""
    p, r = ratio(tp, _c(tp) + _c(fp)), ratio(tp, _c(tp) + _c(fn))
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1")]


def band(score, high: float, low: float, names=("high", "medium", "low"), strict: bool = False) -> Column:
    s = _c(score)
    above = (lambda t: s > t) if strict else (lambda t: s >= t)
    return F.when(above(high), names[0]).when(above(low), names[1]).otherwise(names[2])


def stars(p) -> Column:
    p = _c(p)
    return F.when(p.isNull() | F.isnan(p), "ns").when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("ns")


def json_entities(response, labels: list[str] | None = None) -> Column:
    """array<struct<text,label>> of the JSON array between the first [ and the last ]; anything unreadable gives []."""
    body = F.regexp_extract(_c(response), r"(?s)(\[.*\])", 1)
    items = F.from_json(F.when(body != "", body), "array<struct<text:string,label:string>>")
    known = F.filter(items, lambda x: x["text"].isNotNull() & x["label"].isNotNull() & (x["label"].isin(*labels) if labels else F.lit(True)))
    return F.coalesce(known, F.from_json(F.lit("[]"), "array<struct<text:string,label:string>>"))


def snippet(text, begin, end, around: int = 30) -> Column:
    """The span with ``around`` code points on each side, line breaks as spaces."""
    low = F.greatest(_c(begin) - around, F.lit(0))
    high = F.least(F.length(_c(text)), _c(end) + around)
    return F.translate(F.substring(_c(text), low + 1, F.greatest(high - low, F.lit(0))), "\n", " ")


def sanitize_value(value) -> Column:
    return F.regexp_replace(_c(value), r"\s+", "_")


def label_of(table: Column, key) -> Column:
    """Tag of an id in a map keyed by string; O where it lacks."""
    return F.coalesce(F.try_element_at(table, _c(key).cast("string")), F.lit("O"))


def argmax(scores) -> Column:
    """The first index, from 0, of the largest element."""
    return (F.array_position(_c(scores), F.array_max(_c(scores))) - 1).cast("int")


def softmax_max(scores) -> Column:
    """The softmax probability of the largest element."""
    a = F.transform(_c(scores), lambda x: x.cast("double"))
    return 1 / F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(a)))


# --- values of biomarker spans -----------------------------------------------------------------------------------------
#
# Normalized text is cut to tokens: words (her2 is one), numbers (with the sign that follows), signs, the percent mark.  A hyphen that
# joins two words is none.  Rules are lists of cues in the order they are tried; a cue is tokens with blanks between,
# and a last token that ends in * may go on.  Other languages or markers need other lists only.

TOKENS = r"\p{L}[\p{L}\d]*|\d+\+*|\++|(?<![\p{L}\d])-+|-+(?![\p{L}\d])|%"
VERBS = ["amplifi*", "surexprim*", "surexpress*", "sur exprim*", "sur express*"]
DENIALS = ["non", "pas", "pas de", "pas d", "sans", "absence de", "absence d", "absence d une"]
DENIED = [f"{n} {v}" for n in DENIALS for v in VERBS]
WEAK, STRONG = ["neg*", "tripleneg*", "faible intensite", "-", "--"], ["pos*", "forte intensite", "+", "++", "+++", "++++"]
#: Tokens that name a grade; a bare digit does only after the word score, or if it is 0.
GRADES = {"3+": ["3+", "+++", "trois"], "2+": ["2+", "++", "deux"], "1+": ["1+", "un"], "0": ["0", "0+"]}
STATUS = [("positif", ["her 2 lumb", "her2 lumb", "her 2 enrichi*", "her2 enrichi*"]), ("negatif", DENIED + WEAK), ("positif", VERBS + STRONG)]
FISH = [("en_cours", ["en cours", "en attente"]), ("non_disponible", ["non concluant*"]), ("negatif", DENIED + WEAK), ("positif", VERBS + STRONG)]
RECEPTOR = [("positif", ["pos*", "lumb*", "luminal b", "luminalb*", "+", "++", "+++"]), ("negatif", WEAK)]
#: Units of an age or a duration, and words of a marker's gene test.
AGES, GENE_TESTS = ["an", "ans", "mois", "semaine", "semaines", "jour", "jours"], ["fish", "gene"]


def cue_tokens(norm) -> Column:
    """The tokens of normalized text; a number's signs stay with it, but a sign that follows one with % stands alone."""
    return F.regexp_extract_all(_c(norm), F.lit(TOKENS), F.lit(0))


def says(line: Column, cues: list[str]) -> Column:
    """Whether a line of tokens (a blank before, between and after them) has one of the cues."""
    found = F.lit(False)
    for c in cues:
        found = found | F.contains(line, F.lit(f" {c[:-1]}" if c.endswith("*") else f" {c} "))
    return found


def value_by_cues(norm, rules: list[tuple[str, list[str]]]) -> Column:
    """The value of the first rule of (value, cues) that the text says; null where it says none."""
    line = F.concat(F.lit(" "), F.array_join(cue_tokens(norm), " "), F.lit(" "))
    out = None
    for value, cues in rules:
        out = F.when(says(line, cues), value) if out is None else out.when(says(line, cues), value)
    return out


def ihc_value(norm, grades: dict[str, list[str]] = GRADES) -> Column:
    """The last grade named, 0, 1+, 2+ or 3+; null without one."""
    t = cue_tokens(norm)
    named = {w: g for g, words in grades.items() for w in words}
    table = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    scored = F.create_map(*(F.lit(x) for g in grades for x in (g.rstrip("+"), g)))
    before = lambda i: F.when(i > 0, F.element_at(t, F.greatest(i, F.lit(1))))
    grade = F.transform(t, lambda w, i: F.coalesce(F.when(before(i) == "score", F.try_element_at(scored, w)), F.try_element_at(table, w)))
    return F.try_element_at(F.filter(grade, lambda g: g.isNotNull()), F.lit(-1))


def status_value(norm, rules: list = STATUS) -> Column:
    """positif or negatif: subtypes that tell, then denials, then positive cues; null without any."""
    return value_by_cues(norm, rules)


def fish_value(norm, compat: bool = False, rules: list = FISH) -> Column:
    """en_cours, non_disponible, negatif or positif.  compat: an inflected "non amplifié" is not seen as a denial."""
    if compat:
        rules = [(v, [c for c in cues if c not in DENIED] + ["non amplifi", "non sur exprime"] if cues == DENIED + WEAK else cues) for v, cues in rules]
    return F.coalesce(value_by_cues(norm, rules), F.lit("non_disponible"))


def receptor_value(norm, cut: int = 10, rules: list = RECEPTOR) -> Column:
    """By the last number up to 100 (above the cut: positif), else by cues."""
    numbers = F.transform(cue_tokens(norm), lambda w: F.when(F.length(F.rtrim(w, F.lit("+"))) <= 3, F.rtrim(w, F.lit("+")).try_cast("int")))
    last = F.try_element_at(F.filter(numbers, lambda x: x <= 100), F.lit(-1))
    return F.when(last.isNotNull(), F.when(last > cut, "positif").otherwise("negatif")).otherwise(F.coalesce(value_by_cues(norm, rules), F.lit("non_disponible")))


def percent_value(text) -> Column:
    """The last number of up to three digits, with %; null without one."""
    numbers = F.regexp_extract_all(_c(text), F.lit(r"\d+"), F.lit(0))
    return F.concat(F.try_element_at(F.filter(numbers, lambda x: F.length(x) <= 3), F.lit(-1)), F.lit("%"))


def rejected(text, label=None) -> Column:
    """Matches that are no finding: a bare marker name, a condition, an age or duration, an antibody.

    With a label column, a HER2 status that speaks of both a gene test and the extracellular domain (ECD) is none either.
    """
    t = F.trim(F.translate(F.lower(_c(text)), "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc"))
    words = F.regexp_extract_all(t, F.lit(r"\p{L}+|\d+"), F.lit(0))
    aged = F.exists(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("n"), F.slice(words, 2, F.size(words)).alias("u")), lambda x: x["u"].isin(*AGES) & x["n"].rlike("^[0-9]+$"))
    bare = F.array_join(words, "") == "her2"
    out = bare | F.startswith(t, F.lit("si ")) | aged | F.contains(t, F.lit("anti"))
    if label is not None:
        gene = F.exists(F.array(*(F.lit(w) for w in GENE_TESTS)), lambda w: F.contains(t, w))
        out = out | ((_c(label) == "HER2_status") & gene & F.contains(t, F.lit("ecd")))
    return out


def fit_diagnosis(first, last, least, gap_high: float = 0.05, gap_low: float = 0.02) -> Column:
    """How a loss curve went: OVER when it rose again past gap_high, UNDER when it never fell, MILD past gap_low."""
    rise = _c(last) - _c(least)
    return F.when(rise > gap_high, "OVER").when(_c(first) - _c(last) <= gap_low, "UNDER").when(rise > gap_low, "MILD").otherwise("GOOD")
