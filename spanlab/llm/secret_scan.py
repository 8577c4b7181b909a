"""Secret scans: a keyword automaton, anchored expressions near its hits, then embedded checksums.

Every text becomes UTF-8 bytes in ASCII lower case, read as Latin-1 so that one character is one byte; one pass of an
Aho-Corasick automaton finds the keywords, and the expression of a kind runs only where one of its keywords ends or
starts.  A kind without a keyword (``hex``) is found by its own run expression.  Offsets are code points, end exclusive.

Base kinds: ``assign`` (a credential name, then : or =, then a value of 12 or more), ``access`` (AKIA and in all 18
or more), ``hex`` (16 or more lower-case hexadecimal digits).  Matches of a kind are leftmost and non-overlapping;
those that are too short are found, consume their text, and are dropped.

Added kinds, kept only where the checksum in the token itself holds: ``github`` (gh?_ tokens, CRC-32 in base 62),
``npm`` (the same scheme), ``card`` (payment card numbers after a keyword, Luhn), ``iban`` (after a keyword, mod 97).
"""

from __future__ import annotations

import binascii
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban")
BASE_KINDS = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
CARD = re.compile(rb"(?:card|visa|mastercard|amex)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.I)
IBAN = re.compile(rb"iban[^A-Za-z0-9\n]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.I)

#: keyword -> kinds whose expression starts at the keyword
KEYWORDS = {
    "password": ("assign",), "passwd": ("assign",), "secret": ("assign",), "token": ("assign",), "apikey": ("assign",), "api_key": ("assign",),
    "akia": ("access",),
    "ghp_": ("github",), "gho_": ("github",), "ghu_": ("github",), "ghs_": ("github",), "ghr_": ("github",),
    "npm_": ("npm",),
    "card": ("card",), "visa": ("card",), "amex": ("card",),
    "iban": ("iban",),
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def crc_token_ok(token: bytes) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62, padded with zeros."""
    body, check = token[4:-6], token[-6:].decode("ascii")
    crc, out = binascii.crc32(body), ""
    while crc:
        crc, d = divmod(crc, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0") == check


def luhn_ok(digits: bytes) -> bool:
    n = [x - 48 for x in digits if 48 <= x <= 57]
    total = sum(n[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in n[-2::-2])
    return 13 <= len(n) <= 19 and total % 10 == 0 and len(set(n)) > 1


def iban_ok(text: bytes) -> bool:
    flat = text.replace(b" ", b"").decode("ascii").upper()
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kinds in KEYWORDS.items():
        a.add_word(word, (len(word), kinds))
    a.make_automaton()
    return a


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind in the order of KINDS.  Null is empty."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int, int]] = []
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for last, (size, kinds) in automaton().iter(raw.lower().decode("latin-1")):
        at = last + 1 - size
        for kind in kinds:
            if at < free[kind]:
                continue
            if kind == "assign":
                if m := ASSIGN.match(raw, at):
                    free[kind] = m.end()
                    if m.end(2) - m.start(2) >= 12:
                        found.append((at, 0, m.end()))
            elif kind == "access":
                if m := ACCESS.match(raw, at):
                    free[kind] = m.end()
                    if m.end() - at >= 18:
                        found.append((at, 1, m.end()))
            elif kind in ("github", "npm"):
                if (m := (GITHUB if kind == "github" else NPM).match(raw, at)) and crc_token_ok(m[0]):
                    free[kind] = m.end()
                    found.append((at, KINDS.index(kind), m.end()))
            elif kind == "card":
                if (m := CARD.match(raw, at)) and luhn_ok(m[1]):
                    free[kind] = m.end()
                    found.append((m.start(1), 5, m.end()))
            elif (m := IBAN.match(raw, at)) and iban_ok(m[1]):
                free[kind] = m.end()
                found.append((m.start(1), 6, m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    found.sort()
    if len(raw) == len(text):
        return [Span(KINDS[k], a, b) for a, k, b in found]
    out, at, chars = [], 0, 0
    points: dict[int, int] = {}
    for x in sorted({p for a, _, b in found for p in (a, b)}):
        chars += sum(1 for c in raw[at:x] if c & 0xC0 != 0x80)
        points[x], at = chars, x
    for a, k, b in found:
        out.append(Span(KINDS[k], points[a], points[b]))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span (overlapping ones as one) replaced by [kind]."""
    if not spans:
        return text
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ``spans array<struct<kind,start,end>>``.

    A map over Arrow batches: no shuffle, a task holds one batch.  Null and empty text: no spans.  Null ids and
    repeated rows pass through; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            spans = [[s._asdict() for s in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], names=["id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def span_digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text, from scan_documents' rows."""
    text = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        id_col, *map(count, BASE_KINDS),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """docs, all columns in order, with spans of text_col replaced by [kind] and size_col (where it exists) counted anew.

    A row whose text has no span keeps its text as it is, null included.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: redact(t, find_spans(t)) if t else t)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out
