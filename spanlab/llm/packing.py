"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments, and loss-bearing tokens.  The waiting pieces' demands and the
open sequence's free room are vectors, each in units of its limit; the piece with the largest dot product of the two
that fits goes in next (the longest waits least, a scarce resource counts most).  Where none fits, the piece with the
largest product is cut to the room that is left, so every sequence but a task's last is full of tokens unless
another limit stopped it.  A task's last tokens go to sequences of powers of two, the sizes that need no padding.

Each task packs its own input partition and holds at most WAITING pieces, of less than a sequence each: there is no
shuffle, and a lost task is repeated alone.  sequence_id = partition << 40 | number in the partition.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.bpe import compile_split

MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS, WAITING = 4096, 1024, 4096, 512
#: Chunks, and words, that a task remembers: some 250 bytes each.
CACHE_ENTRIES = 200_000


def trimmed(memory: dict) -> dict:
    """memory, or where it is full its older half: what came first comes most often, the rest makes room."""
    return dict(islice(memory.items(), CACHE_ENTRIES // 2)) if len(memory) > CACHE_ENTRIES else memory


class WordEncoder:
    """ids of a whole text by a tokenizers file, as the library gives them, a chunk without white space at a time.

    The file must split at white space (checked), so a chunk's ids do not depend on what is around it.  Each distinct
    chunk is worked once and remembered.  Chunks of code points below PLAIN are split to words here, and each distinct
    word goes through the library once; all others - with marks to compose, letters of newer Unicode tables - and those
    with a special token's first characters go through the library whole.
    """

    #: Below it nothing composes, and letters, digits and cases are the same in all Unicode versions of this century.
    PLAIN = "\u0250"

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if {*kinds} - {"NFC", "Replace", "Lowercase"} or not steps or steps[0]["type"] != "Split" or not steps[0]["invert"] or r"[^\s" not in steps[0]["pattern"].get("Regex", ""):
            raise ValueError(f"{path}: not a tokenizer that removes white space")
        if any(x["lstrip"] or x["rstrip"] or len(x["content"].split()) != 1 for x in spec["added_tokens"]):
            raise ValueError(f"{path}: special tokens that hold white space")
        spec["truncation"] = spec["padding"] = None
        if len(steps) != 2 or steps[1]["type"] != "ByteLevel" or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            raise ValueError(f"{path}: words that are not byte-level")
        self.special = {x["content"][:2] for x in spec["added_tokens"]}
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.merge, self.lower = self.library.model.tokenize, "Lowercase" in kinds
        printed = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that stand for themselves; the others follow 255
        self.letters = {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in printed)}
        self.strange = re.compile(f"[^\0-{chr(ord(self.PLAIN) - 1)}]").search
        self.split = compile_split(steps[0]["pattern"]["Regex"], ord(self.PLAIN) - 1).findall
        self.runs = all(self.split(x) == [x] for x in ("a", "abc", "ABCxyz", "s", "ll", "q" * 300))  # letters alone are one word
        self.seen: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Unsigned little-endian 32-bit ids."""
        found = text.encode("utf-8", "replace").split()  # at \x20 and \x09-\x0D; the library sees to other white space
        seen = self.seen
        out = [*map(seen.get, found)]
        if None in out:
            new = [*{w for w, x in zip(found, out) if x is None}]
            fresh = self._fresh(new)
            out = [fresh[w] if x is None else x for w, x in zip(found, out)]
            self.seen = seen = trimmed(seen)
            seen.update((w, x) for w, x in fresh.items() if len(w) <= 64)
        return b"".join(out)

    def _word(self, y: str) -> bytes:
        """Ids of one word: the model's merges over its bytes; printable ASCII stands for itself."""
        if not (y.isascii() and y.isprintable()):
            y = y.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merge(y)]).tobytes()

    def _fresh(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """The chunks' ids."""
        self.known = known = trimmed(self.known)
        out, whole = {}, []
        text = b" ".join(chunks).decode()
        odd = self.strange(text) or any(t in text for t in self.special)
        for w, x in zip(chunks, text.split(" ")):
            if odd and (self.strange(x) or any(t in x for t in self.special)):
                whole.append(x)
                continue
            ids = []
            low = x.lower() if self.lower else x
            for y in (low,) if self.runs and x.isascii() and x.isalpha() else self.split(low):
                i = known.get(y)
                if i is None:
                    i = self._word(y)
                    if len(y) <= 64:
                        known[y] = i
                ids.append(i)
            out[w] = b"".join(ids)
        out.update((x.encode(), array("I", e.ids).tobytes()) for x, e in zip(whole, self.library.encode_batch_fast(whole, add_special_tokens=False)))
        return out


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Packer:
    """Sequences of pieces, from examples that are added one by one.

    An example is (id, ids as bytes, loss): loss is how many of its tokens bear loss, spread evenly over the pieces
    when it is cut; it is taken as 0 to the number of tokens.  An example without tokens makes no piece.  ``rows`` gathers (id, start, length, crc32, total,
    sequence number, offset) of closed sequences.
    """

    def __init__(self, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, waiting: int = WAITING):
        if min(max_tokens, max_segments, max_loss, waiting) < 1:
            raise ValueError("limits must be at least 1")
        self.limits = np.array([max_tokens, max_segments, max_loss], float)
        self.waiting = waiting
        self.items: list[tuple] = []  # (id, ids, start, total, loss per token)
        self.need = np.zeros((waiting + 1, 3))
        self.room = self.limits.copy()
        self.open: list[tuple] = []  # pieces of the open sequence
        self.sequence = 0
        self.rows: list[tuple] = []

    def _wait(self, item: tuple) -> None:
        n = len(item[1]) // 4
        if len(self.items) == len(self.need):
            self.need = np.vstack([self.need, np.zeros_like(self.need)])
        self.need[len(self.items)] = n, 1, n * item[4]
        self.items.append(item)

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, ids, start, total, _ in pieces:
            n = len(ids) // 4
            self.rows.append((key, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += bool(pieces)

    def _reopen(self, tokens: int | None = None) -> None:
        self._close(self.open)
        self.open, self.room = [], self.limits.copy()
        if tokens:
            self.room[0] = tokens

    @staticmethod
    def _cut(item: tuple, n: int) -> tuple[tuple, tuple | None]:
        key, ids, start, total, loss = item
        return (key, ids[: 4 * n], start, total, loss), (key, ids[4 * n :], start + n, total, loss) if 4 * n < len(ids) else None

    def add(self, key, ids: bytes, loss: int | None = None) -> None:
        total = len(ids) // 4
        item = (key, memoryview(ids), 0, total, 1.0 if loss is None else min(max(loss, 0), total) / max(total, 1)) if total else None
        whole = int(self.limits[0])
        while item and len(item[1]) // 4 >= whole and whole * item[4] <= self.limits[2]:  # a sequence of its own
            piece, item = self._cut(item, whole)
            self._close([piece])
        if item:
            self._wait(item)
        while len(self.items) >= self.waiting:
            self._step()

    def _step(self) -> None:
        """Place one waiting piece or a part of it, or close the open sequence."""
        need = self.need[: len(self.items)]
        score = (need / self.limits) @ (self.room / self.limits)
        fits = (need <= self.room + 1e-9).all(axis=1)
        if fits.any():
            k = int(np.where(fits, score, -1).argmax())
            n = len(self.items[k][1]) // 4
        else:
            k = int(score.argmax())
            loss = self.items[k][4]
            n = int(min(self.room[0], (self.room[2] + 1e-9) / loss if loss else self.room[0])) if self.room[1] >= 1 else 0
            if n < 1:
                self._reopen()
                return
        piece, rest = self._cut(self.items[k], n)
        self.open.append(piece)
        self.room -= (n, 1, n * piece[4])
        if rest:
            self.items[k] = rest
            self.need[k] -= (n, 0, n * piece[4])
        else:
            last = self.items.pop()
            if k < len(self.items):
                self.items[k], self.need[k] = last, self.need[len(self.items)]
        if self.room[0] < 1:
            self._reopen()

    def finish(self) -> None:
        """Place all that waits.  What would leave the last sequence short goes to powers of two instead."""
        tokens = lambda x: sum(len(i[1]) for i in x) // 4
        while self.items and tokens(self.items) + tokens(self.open) >= self.limits[0]:
            self._step()
        for item in self.open:
            self._wait(item)
        self.open = []
        while self.items:
            self._reopen(1 << int(min(tokens(self.items), self.limits[0])).bit_length() - 1)
            now = self.sequence
            while self.items and self.sequence == now:
                self._step()
        self._reopen()


def pack_documents(docs: DataFrame, encode: Callable[[], Callable[[str], bytes]], end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None,
                   max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS, waiting: int = WAITING) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encode()`` gives, once per task, the function from text to ids (unsigned little-endian 32-bit); ``end_id`` is
    appended to each.  ``loss_col`` counts an example's loss-bearing tokens (null or no column: all; below 0: none; above
    its tokens: all).  Null text is
    empty, and without end_id empty text makes no piece.  Rows are packed as rows: repeated rows, and rows with equal or null ids, are
    examples of their own.  Other columns are dropped.
    """
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, p = encode(), Packer(max_tokens, max_segments, max_loss, waiting)
        base = TaskContext.get().partitionId() << 40

        def out(kind) -> pa.RecordBatch:
            cols = [*zip(*p.rows)] or [[]] * 7
            p.rows = []
            cols[5] = [base + x for x in cols[5]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in (cols[1], cols[2], cols[3], cols[4], cols[5], cols[6]))], names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        kind = None
        for b in batches:
            kind = b.column(0).type
            for key, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                p.add(key, enc(text or "") + tail, loss)
            yield out(kind)
        p.finish()
        if kind is not None:
            yield out(kind)

    kind = docs.schema[id_col].dataType.simpleString()
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), loss.alias("loss"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").withColumnRenamed("id", id_col)
