"""Near-duplicates, lines, passages, vectors and the pipeline: against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlab.llm import automaton, embed, lines, minhash, secret_scan, suffix
from spanlab.llm.common import connected_components

from .conftest import PASSAGE, ROWS
from .test_maps import check_packing

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = components({x for a, b in links if a != b for x in (a, b)}, links)
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def corpus(seed: int) -> dict[int, str]:
    """Texts with copies, near copies, chains of near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") * rng.randrange(1, 3)
    texts = [" ".join(word() for _ in range(rng.choice([2, 5, 40, 90]))) for _ in range(40)]
    for t in texts[:20]:
        w = t.split()
        for _ in range(rng.randrange(4)):
            w = w[:]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    shared = " ".join(word() for _ in range(50))
    texts += [f"{' '.join(word() for _ in range(9))} {shared}\n{' '.join(word() for _ in range(7))}" for _ in range(6)]
    texts += [texts[0], "", "ab " * 200, "AB " * 200]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_documents(spark, seed):
    docs = corpus(seed)
    sets = {}
    for d, t in docs.items():
        w = t.translate(LOWER).encode().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(docs, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(docs, links)
    got = minhash.near_documents(spark.createDataFrame([*docs.items()], "doc_id long, text string"), size=4).collect()
    assert {r.d: r.component_id for r in got} == want and {r.d: r.n_shingles for r in got} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (r.d == r.component_id) for r in got)


def test_near_blocks_and_large_groups(spark, monkeypatch):
    """Groups far above a block's size, of which the leader links only a part."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    docs = {}
    for i in range(60):
        w = base[:]
        for _ in range(rng.randrange(12)):
            w[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(w)
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(197)} for d, t in docs.items()}
    want = components(docs, [(a, b) for a, b in itertools.combinations(docs, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    from spanlab.llm import pairs

    monkeypatch.setattr(pairs.in_blocks, "__defaults__", (8,))
    got = minhash.near_documents(spark.createDataFrame([*docs.items()], "doc_id long, text string"), size=4).collect()
    assert {r.d: r.component_id for r in got} == want


def test_recall_near_the_bound(spark):
    """2,000 pairs of similarity 0.80 to 0.85: no more are missed than 16 bands of 4 allow."""
    rng = random.Random(11)
    docs, linked = {}, []
    while len(linked) < 2000:
        a = [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(60, 120))]
        b = a[: len(a) - rng.randrange(1, len(a) // 5)]
        b += [f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(len(a) - len(b) + 1))]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        if 80 * len(x | y) <= 100 * len(x & y) <= 85 * len(x | y):
            i = len(docs)
            docs |= {i: " ".join(a), i + 1: " ".join(b)}
            linked.append(i)
    got = {r.d: r.component_id for r in minhash.near_documents(spark.createDataFrame([*docs.items()], "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in linked) >= 1998  # of 2,000 pairs at 0.80 exactly 0.4 are missed on average
    assert all(got[i] in (i, i - 1) for i in docs)


def test_automaton_of_nothing():
    none = automaton.SuffixAutomaton()
    none.finish()
    assert none.owners("abcd", 2) == [automaton.LAST_ID] * 3 and none.owners("", 2) == [] == none.owners("a", 2)
    some = automaton.SuffixAutomaton()
    some.add("", 1)
    some.add("abc", 7)
    some.finish()
    assert some.owners("xabc", 2) == [automaton.LAST_ID, 7, 7]


def test_repeated_rows_keep_the_first_line(spark):
    """With keep_first the first of repeated rows does not drop its own line."""
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "a\nc"), (2, "a\nc"), (3, "a")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2, keep_first=True)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a\nb"), (1, "a\nb"), (2, "c"), (2, "c"), (3, "")]


def test_written_tables_go(spark):
    """What is written inside a scratch goes at its end, but for what is kept; what is shuffled to write it goes at once."""
    from spanlab.llm.common import materialize, scratch

    with scratch(spark) as keep:
        a = materialize(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        with scratch(spark) as inner:
            b = materialize(a.where("k > 2"))
            inner(b)
        c = materialize(b.where("k > 4"))
        keep(c)
    assert c.count() == 2
    for gone in (a, b):
        with pytest.raises(Exception, match="(?i)not.exist|no such file"):
            gone.collect()


def test_pipeline_leaves_little(spark):
    """After a run only its last documents, and what its last stage wrote, are left in the shared folder."""
    import corpus_pipeline
    from spanlab.llm import common

    path = spark._jvm.org.apache.hadoop.fs.Path(common._folder(spark))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    tables = lambda: {x.getPath().getName() for x in fs.listStatus(path)} if fs.exists(path) else set()
    before = tables()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(tables() - before) == 1 and out.count() > 0


def test_circulant_signature():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.2
    c = minhash.circle()
    assert (c[5][1:] == c[6][:-1]).all()  # coordinates are shifts of one permutation


def test_near_odd(odd, empty):
    got = minhash.near_documents(odd)
    assert got.count() == len(ROWS) and got.where("n_shingles = 0 and not first").count() == 0
    kept = minhash.drop_near_documents(odd)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert sum(bool(t) and t.startswith(PASSAGE) for t in texts) == 1 and sum(t == "a " * 3000 for t in texts) == 1
    assert minhash.near_documents(empty).count() == 0 and minhash.drop_near_documents(empty).count() == 0


def brute_lines(docs, least, first=False):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    n = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")})
    seen, out = set(), {}
    for d in sorted(docs):
        kept = []
        for x in docs[d].split("\n"):
            k = key(x)
            if k and n[k] >= least and (not first or k in seen):
                continue
            seen.add(k)
            kept.append(x)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize("least, first", [(3, False), (2, True), (10, False)])
def test_lines(spark, least, first):
    rng = random.Random(least)
    pool = ["", "Hot line ", "hot LINE", *(f"line {i}" for i in range(12)), "é É", "\tx\r"]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) for i in range(60)}
    docs[60] = "hot line\n" * 5000
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    want = brute_lines(docs, least, first)
    got = lines.line_digests(df, least, keep_first=first).collect()
    assert {r.doc_id: r.kept_sha256 for r in got} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert {r.doc_id: r.n_lines for r in got} == {d: t.count("\n") + 1 for d, t in docs.items()}
    texts = lines.dedup_lines(df, least, keep_first=first)
    assert {r.doc_id: r.text for r in texts.collect()} == want


def test_lines_odd(odd, empty):
    got = lines.dedup_lines(odd, 2)
    assert got.columns == odd.columns and got.count() == len(ROWS) and got.where("text is null").count() == 2
    assert lines.line_digests(odd).count() == len(ROWS) and lines.line_digests(empty).count() == 0 and lines.dedup_lines(empty).count() == 0


def test_lines_count_ids(spark):
    """A document is an id: twelve rows of six ids are six documents."""
    rows = [(i % 6, f"Same line\nrow {i}") for i in range(12)] + [(7, "same LINE ")] * 5
    for least, gone in ((7, True), (8, False)):
        got = lines.line_digests(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
        assert len(got) == 17 and {r.n_dropped for r in got} == {int(gone)}


def test_hot_lines_are_not_held(spark):
    """One key over many batches, documents and partitions: rows are let go once the key is known to go."""
    rows = [(i, "hot\n" * 40 + f"own {i}\nwarm" * (i < 9)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        for first in (False, True):
            want = brute_lines(dict(rows), 10, first)
            assert {r.doc_id: r.text for r in lines.dedup_lines(df, 10, keep_first=first).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_clashing_names(spark):
    """Columns called as the operators' own come back as they were."""
    rows = [(i, f"common\n{PASSAGE} {i}", "mine", "yours", 0.5, "h") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __d string, __k string, __p double, __h string").withColumns({c: F.lit(c) for c in ("__drops", "__kept", "__host", "__path", "__n", "__s", "__hn", "__hs", "__D_")})
    other = [c for c in df.columns if c != "text"]
    want = {tuple(r) for r in df.select(*other).collect()}
    from spanlab.llm import quality

    for got in (lines.dedup_lines(df, 10), quality.score_documents(df, quality.Evidence(), "__d", "__k").select(*df.columns)):
        assert got.columns == df.columns and {tuple(r) for r in got.select(*other).collect()} == want
    kept = minhash.drop_near_documents(df)
    assert kept.columns == df.columns and len(r := kept.collect()) == 1 and tuple(r[0][c] for c in other) in want


def test_repeated_rows_choose_alike(spark):
    """Of rows equal in id and text the same one stays, however they are dealt."""
    rows = [(1, PASSAGE, f"c{i}") for i in range(30)] + [(2, "", "x"), (2, "", "x")]
    picks = {tuple(sorted(tuple(r) for r in minhash.drop_near_documents(spark.createDataFrame(x, "doc_id long, text string, source string").repartition(n)).collect())) for x, n in ((rows, 1), (rows[::-1], 4), (rows, 7))}
    assert len(picks) == 1 and len(next(iter(picks))) == 2


def brute_bytes(texts, size):
    raw = [t.encode() for t in texts]
    n = Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if n[b[i : i + size]] > 1:
                m[i : i + size] = True
        out.append((len(b), int(m.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("seed, size", [(1, 60), (2, 200), (3, 40)])
def test_byte_passages(spark, seed, size):
    docs = corpus(seed)
    docs[1000] = "ab" * 400
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.passage_digests(spark.createDataFrame([*docs.items()], "doc_id long, text string"), size).collect()}
    assert got == dict(zip(docs, brute_bytes([*docs.values()], size)))


def test_bytes_that_differ_in_one_place(spark):
    """Passages with one anchor that differ in one byte, any of the printable ones and those of longer characters, are compared byte by byte."""
    rng = random.Random(8)
    core = "".join(rng.choices("abcdefghij", k=100))
    docs = {i: core[:3] + c + core[4:] for i, c in enumerate([*map(chr, range(32, 127)), *"àéîõüßжщ日"])}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.passage_digests(spark.createDataFrame([*docs.items()], "doc_id long, text string"), 100).collect()}
    assert got == dict(zip(docs, brute_bytes([*docs.values()], 100)))


def test_byte_pieces(spark, monkeypatch):
    """Documents longer than a piece, in which anchors' runs are cut."""
    from spanlab.llm import repeats

    docs = corpus(5)
    docs[500] = docs[3] * 3 + " ".join(docs.values())
    runs = []
    for piece in (1 << 20, 300):
        monkeypatch.setattr(repeats, "PIECE", piece)
        sym = [suffix.byte_symbols(t) for t in docs.values()]
        cover = Counter()
        for names, s, starts in repeats._pieces(iter(sym), 60):
            for doc, _, first, last, _, _ in zip(*repeats.owned_runs(s, starts, 60, 32)):
                d, off = names[doc]
                cover.update((d, x - starts[doc] + off) for x in range(first, last + 1))
        runs.append(cover)
    assert runs[0] == runs[1] and max(runs[0].values()) == 1  # every window is owned once


def test_suffix_sort():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 99, 640, dtype=np.uint8), np.zeros(640, np.uint8)])
    order = suffix.sort_suffixes(suffix._eights(text), np.arange(600), 200)
    raw = text.tobytes()
    for r in range(suffix.V):
        mine = order[r].tolist()
        assert {i % suffix.V for i in mine} == {r} and len(mine) in (18, 19)
        assert mine == sorted(mine, key=lambda i: raw[i : i + 232])
    d = suffix.COVER
    assert {(a - b) % suffix.V for a in d for b in d} == set(range(suffix.V))


def brute_words(docs, size):
    first = {}
    for d in sorted(docs):
        w = docs[d].encode().split()
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), d)
    out = {}
    for d, t in docs.items():
        w = t.encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("seed, size", [(1, 13), (2, 5), (3, 13)])
def test_word_passages(spark, seed, size):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automaton.passage_digests(spark.createDataFrame([*docs.items()], "doc_id long, text string"), size).collect()}
    assert got == brute_words(docs, size)


def test_word_passages_twice_in_a_document(spark):
    """A line again and again in one document, or in rows of one id, of which an earlier document has all or a part in other surroundings."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    line, part = words(20), words(40)
    rows = [(3, words(15) + line + words(15)), (5, line * 8), (2, part[:24]), (6, words(3) + (part + words(2)) * 6), (7, line + part), (7, line + words(1) + part + part)]
    rows += [(8, x) for y in [words(30)] for x in (y + words(4), words(4) + y + y)] + [(None, line + line), (9, words(2) + line + line + part)]
    order = lambda d: float("inf") if d is None else d
    least = {}
    for d, w in rows:
        for i in range(len(w) - 12):
            g = tuple(w[i : i + 13])
            least[g] = min(least.get(g, float("inf")), order(d))
    want = []
    for d, w in rows:
        gone = {i + j for i in range(len(w) - 12) if least[tuple(w[i : i + 13])] < order(d) for j in range(13)}
        want.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert want[1][:3] == (5, 160, 160)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = automaton.passage_digests(df, 13).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def crowd(n: int, seed: int = 4) -> dict[int, str]:
    """Documents that share a passage's middle in surroundings of their own, some of them alike a little further out."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    core, sides = words(9), [words(3) for _ in range(5)]
    return {i: " ".join(words(5) + rng.choice(sides)[rng.randrange(3) :] + core + rng.choice(sides)[: rng.randrange(1, 4)] + words(5)) for i in range(n)}


def test_crowded_anchors(spark, monkeypatch):
    """Anchors of more contexts than may meet are split by what is around them, without loss."""
    from spanlab.llm import repeats

    monkeypatch.setattr(repeats, "GROUP", 4)
    docs = corpus(6) | {1000 + i: t for i, t in crowd(80).items()}
    df = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in automaton.passage_digests(df).collect()}
    assert got == brute_words(docs, 13)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix.passage_digests(df, 70).collect()}
    assert got == dict(zip(docs, brute_bytes([*docs.values()], 70)))


def test_crowds_grow_in_proportion(spark, monkeypatch):
    """Twice the documents that share an anchor make twice the contexts, not four times."""
    from spanlab.llm import repeats

    monkeypatch.setattr(repeats, "GROUP", 8)
    made = []
    write = repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df: [made.append(df.columns), counts.append((w := write(df)).count())] and w)
    sums = []
    for n in (1000, 2000):
        counts: list[int] = []
        docs = crowd(n)
        automaton.passage_digests(spark.createDataFrame([*docs.items()], "doc_id long, text string")).count()
        sums.append(sum(counts))
    assert "a0" in str(made) and sums[1] < 2.2 * sums[0]


def test_neighbours():
    import pyarrow as pa

    from spanlab.llm import repeats

    rng = random.Random(3)
    for _ in range(200):
        a = sorted(rng.randrange(12) for _ in range(rng.randrange(1, 30)))
        cuts = sorted({0, len(a), *(rng.randrange(len(a) + 1) for _ in range(4))})
        batches = [pa.RecordBatch.from_arrays([pa.array(a[s:e], pa.int64()), pa.array([*range(s, e)], pa.int64())], names=["a", "i"]) for s, e in zip(cuts, cuts[1:])]
        got = [i for b in repeats.neighbours(iter(batches)) for i in b.column(1).to_pylist()]
        assert got == [i for i, x in enumerate(a) if i in (0, len(a) - 1) or x in (a[i - 1], a[i + 1])]


def test_automaton():
    rng = random.Random(8)
    seqs = [[rng.choice("ab") for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    a = automaton.SuffixAutomaton()
    for i, s in enumerate(seqs):
        a.add(s, i)
    a.finish()
    for i, s in enumerate(seqs):
        for size in (3, 6):
            want = [min(j for j, o in enumerate(seqs) if "".join(s[x : x + size]) in "".join(o)) for x in range(len(s) - size + 1)]
            assert a.owners(s, size) == want
    assert automaton.SuffixAutomaton().owners(["a", "b"], 1) == [automaton.LAST_ID] * 2  # of nothing; and an empty sequence changes nothing
    a.add([], 0)
    a.finish()
    assert a.owners([], 3) == [] and a.owners(["z"] * 4, 3) == [automaton.LAST_ID] * 2


def test_passages_odd(odd, empty):
    b = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.passage_digests(odd).collect()}
    n = len((PASSAGE + " tail").encode())
    assert (3, n, n) in b and (4, 0, 0) in b and (None, 0, 0) in b and (10, 5000, 5000) in b
    w = {(r.doc_id, r.n_words, r.n_removed) for r in automaton.passage_digests(odd).collect()}
    assert (1, 60, 0) in w and (2, 60, 60) in w and (3, 61, 60) in w and (None, 62, 60) in w
    assert suffix.passage_digests(odd).count() == automaton.passage_digests(odd).count() == len(ROWS)
    assert suffix.passage_digests(empty).count() == automaton.passage_digests(empty).count() == 0


def brute_vectors(rows, least):
    good = {i: np.array(v, float) for i, (_, la, v) in enumerate(rows) if la is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(i, j) for i, j in itertools.combinations(good, 2) if rows[i][1] == rows[j][1] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.sqrt(good[i] @ good[i] * (good[j] @ good[j])) >= least]
    n = Counter(x for p in links for x in p)
    comp = components(range(len(rows)), links)
    return {rows[i][0]: (n[i], rows[comp[i]][0]) for i in range(len(rows))}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [(i, int(i % 3), (base[i % 12] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])).tolist()) for i in range(240)]
    rows += [(240 + i, 1, rows[1][2]) for i in range(30)]
    rows += [(300, None, rows[0][2]), (301, 0, None), (302, 0, [0.0] * 16), (303, 0, [float("nan")] * 16), (304, 0, [None] * 16), (305, 0, [float("inf")] + [1.0] * 15), (306, 0, [1.0, 2.0]), (307, 0, [1.0, 2.0]), (308, 0, [])]
    want = brute_vectors(rows, 0.93)
    assert sum(n for n, _ in want.values()) > 300
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("a", F.lit(1)).withColumn("v", F.lit("x"))
    got = embed.near_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed.near_vectors(df.where("false")).count() == 0


def test_vectors_of_extreme_size(spark):
    """Products that would overflow or vanish in double precision."""
    rows = [(1, 0, [1e200, 1e200]), (2, 0, [1e200, 1.01e200]), (3, 0, [1e-200, 1e-200]), (4, 0, [5e-324, 0.0]), (5, 0, [1e-320, 0.0]), (6, 0, [-1e200, 1e200]), (7, 0, [1e308, 1.0e308])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 7: (3, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_vector_blocks(spark, monkeypatch):
    from spanlab.llm import pairs

    rng = np.random.default_rng(5)
    rows = [(i, 0, (np.ones(8) + rng.standard_normal(8) * 0.2).tolist()) for i in range(120)]
    monkeypatch.setattr(pairs.in_blocks, "__defaults__", (16,))
    got = embed.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_vectors(rows, 0.93)


def test_pipeline(spark, tmp_path, odd):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == columns and after.keys() <= before.keys() and all(r.n_chars == len(r.text) for r in after.values())
        if name == "line_dedup":
            assert {d: r.text for d, r in after.items()} == brute_lines({d: r.text for d, r in before.items()}, 10)
        if name == "near_dedup":
            assert len(after) < len(before)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    first = {r.doc_id for r in spark.read.parquet(str(tmp_path / "quality")).collect()}
    assert len(first) < n and len(good & first) >= 0.95 * len(good)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(after)
    d = odd.select(*columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (d, d.where("false")):
            assert stage(spark, table, sf).columns == columns


def brute_near(docs, size=5):
    """One document of each group, the least id, by all pairs."""
    sets = {}
    for d, t in docs.items():
        w = t.translate(LOWER).encode().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    links = [(a, b) for a, b in itertools.combinations(docs, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: docs[d] for d, c in components(docs, links).items() if d == c}


def brute_redacted(text):
    """Code point by code point; a span that starts in another goes with it."""
    spans, out, i = secret_scan.find_spans(text), [], 0
    while i < len(text):
        here = [s for s in spans if s.start == i]
        if not here:
            out.append(text[i])
            i += 1
            continue
        out.append(f"[{here[0].kind}]")
        end = max(s.end for s in here)
        while more := [s.end for s in spans if i <= s.start < end < s.end]:
            end = max(more)
        i = end
    return "".join(out)


def test_pipeline_whole(spark):
    """run() packs what brute force leaves of the classifier's documents: every id, length and crc32."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = corpus_pipeline.good_documents(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    lined = brute_lines({r.doc_id: r.text for r in docs.collect()}, 10)
    near = brute_near(lined)
    clean = {d: brute_redacted(t) for d, t in near.items()}
    assert len(near) < len(lined) and clean != near
    encode = corpus_pipeline.word_ids()
    ids = {d: [*np.frombuffer(encode(t), "<u4").tolist(), 2] for d, t in clean.items()}
    rows = corpus_pipeline.run(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()
    sizes, _ = check_packing([tuple(r) for r in rows], ids)
    assert max(sizes) <= 4096


def test_links_of_a_crowded_label_are_counted_not_listed(spark, monkeypatch):
    """Rows written grow with the vectors in cells of up to CHUNK rows; crowded cells are worked in parts with the same result."""
    rng, grown, whole = np.random.default_rng(5), [], embed.CHUNK
    for n, chunk in ((150, 64), (150, whole), (300, whole)):
        monkeypatch.setattr(embed, "CHUNK", chunk)
        centre = rng.standard_normal(16)
        x = np.concatenate([centre + rng.standard_normal((n, 16)) * 0.2, rng.standard_normal((50, 16)), centre[None] * [[1], [2], [1e-200]]])
        rows = [(i, i % 2 if i < n else 1, v.tolist()) for i, v in enumerate(x)]
        written, plain = [], embed.materialize
        monkeypatch.setattr(embed, "materialize", lambda df: written.append(plain(df)) or written[-1])
        monkeypatch.setattr(embed, "discard", lambda t: None)
        got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
        monkeypatch.setattr(embed, "materialize", plain)
        unit = embed.unscaled(x) / np.linalg.norm(embed.unscaled(x), axis=1, keepdims=True)
        label = np.array([r[1] for r in rows])
        near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
        want, least = {}, np.arange(len(x))
        for _ in range(len(x)):
            least = np.array([least[near[i]].min() for i in range(len(x))])
        for i in range(len(x)):
            want[i] = (int(near[i].sum()) - 1, int(least[i]))
        assert got == want
        grown.append(sum(t.where("kind <> 2").count() for t in written if "kind" in t.columns))
    assert grown[2] < 3 * grown[1]


def test_joining_links_span_components():
    rng = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 3), (40, 30), (40, 300)):
        i, j = rng.integers(0, n, (2, m))
        up = np.arange(n)
        kept = embed.joining(i, j, up)
        plain = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j):
                plain[a] = plain[b] = min(plain[a], plain[b])
        assert up.tolist() == plain.tolist() and len(kept) == n - len(set(plain.tolist()))
        again = np.arange(n)
        embed.joining(i[kept], j[kept], again)
        assert again.tolist() == plain.tolist()
