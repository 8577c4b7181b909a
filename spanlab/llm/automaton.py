"""Substring dedup: word passages that an earlier document has, by suffix automata of reference shards.

Candidates come from repeats.py as contexts grouped by a shared anchor.  Each group is a shard: its contexts build one
suffix automaton whose states know the least document they occur in, and every context is streamed through it for
matching statistics.  For each window of ``size`` words that gives the least document; a document loses the words
of the windows whose least document is smaller than itself.  The operator's spans are maximal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlab.llm.repeats import merged, repeated_spans
from spanlab.llm.suffix import keyed

SIZE, GRAM = 13, 4
#: Null ids come after all others.
LAST_ID = (1 << 63) - 1


class SuffixAutomaton:
    """Of several sequences; least[s] is the smallest owner of the sequences that state s occurs in.

    An empty sequence adds nothing, whoever owns it; an automaton of none finds none: each window's owner is LAST_ID, and words
    fewer than a window have no window.
    """

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST_ID]

    def _state(self, moves: dict, link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.least.append(LAST_ID)
        return len(self.next) - 1

    def _split(self, p: int, word, q: int) -> int:
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        self.least[clone] = self.least[q]
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words, owner: int) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
            else:
                new, p = self._state({}, 0, self.length[last] + 1), last
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][w]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
                last = new
            self.least[last] = min(self.least[last], owner)

    def finish(self) -> None:
        """Hand the least owners up the links, longest first."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def owners(self, words, size: int) -> list[int]:
        """For each window of size words the least owner of a sequence that it occurs in; LAST_ID where there is none."""
        state, length, out = 0, 0, [LAST_ID] * max(len(words) - size + 1, 0)
        moves, link, lengths, least = self.next, self.link, self.length, self.least
        for i, w in enumerate(words):
            while state and w not in moves[state]:
                state = link[state]
                length = lengths[state]
            if w in moves[state]:
                state, length = moves[state][w], length + 1
            while state and lengths[link[state]] >= size:
                state = link[state]
                length = lengths[state]
            if length >= size:
                out[i - size + 1] = least[state]
        return out


def compare_words(t: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """Ranges of windows by least owner (see repeats.py), those that some run's document exceeds."""
    owner, most = t.column("least").to_pylist(), t.column("most").to_pylist()
    raw = np.frombuffer(b"".join(t.column("s").to_pylist()), np.uint64).tolist()
    ends = (np.cumsum(pc.binary_length(t.column("s")).to_numpy()) // 8).tolist()
    words = [raw[x:y] for x, y in zip([0, *ends], ends)]
    a = t.column("a").to_numpy()
    cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
    out: list[tuple] = []
    for begin, end in zip(cuts, cuts[1:]):
        shard = SuffixAutomaton()
        for i in range(begin, end):
            shard.add(words[i], owner[i])
        shard.finish()
        for i in range(begin, end):
            found, s = shard.owners(words[i], size), 0
            for j in range(1, len(found) + 1):
                if j == len(found) or found[j] != found[s]:
                    if found[s] < most[i]:
                        out.append((i, s, j - 1, found[s]))
                    s = j
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def word_symbols(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+, unchanged."""
    h = xxhash.xxh64_intdigest
    return np.array([h(w) for w in (text or "").encode("utf-8", "surrogatepass").split()], np.uint64)


def earlier_passages(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' id (as ``d``), ``k``, ``text`` and ``spans array<struct<s,e>>`` of words to remove, null where there are none.

    A word goes if a window of ``size`` words over it also starts in a document of smaller id.  Null ids are larger
    than all others and equal to each other; rows of equal ids do not remove each other's words.
    """
    rows = keyed(docs, id_col, text_col, LAST_ID)
    spans = repeated_spans(rows, word_symbols, size, min(GRAM, size), True, compare_words, 8)
    return rows.join(spans, ["d", "k"], "left")


def passage_digests(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, gone, sha = [], [], [], []
            for d, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                ids.append(None if d == LAST_ID else d)
                n.append(len(words))
                cuts = merged(spans)
                for s, e in reversed(cuts):
                    del words[s:e]
                gone.append(sum(e - s for s, e in cuts))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (ids, n, gone)), pa.array(sha, pa.string())], names=["id", "n_words", "n_removed", "kept_sha256"])

    out = earlier_passages(docs, size, id_col, text_col).select("d", "text", "spans")
    return out.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)
