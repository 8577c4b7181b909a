"""Tokenizer, secrets, packing, fingerprints, quality: against brute force, round trips and held-out labels."""

import hashlib
import random
import re
import zlib
from array import array
from binascii import crc32

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlab.llm import bpe, packing, quality, secret_scan, winnow
from spanlab.llm.queries import RANKS, WORDS, word_ids

from .conftest import ROWS


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_library(codec, library, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_bpe_documents(spark, odd, empty, codec, library):
    got = bpe.encode_documents(odd, RANKS, public_tokenizers.PATTERN)
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got.collect()) == sorted((str(d), tuple(library.encode_ordinary(t or ""))) for d, t in ROWS)
    back = bpe.decode_documents(got, RANKS, public_tokenizers.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((t or "").encode() for _, t in ROWS)
    dig = bpe.roundtrip_digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in dig) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert bpe.roundtrip_digests(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def token(prefix: str, body: str) -> str:
    crc, out = crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        out = secret_scan.BASE62[d] + out
    return prefix + body + out.rjust(6, "0")


def test_secrets():
    base = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "API", "key", "AKIA", "akia", "=", ": ", '"', "é", "😀", " ", "\n", "abcdef0123456789", "ABCD1234EFGH5678", "secret", "short", "ſ", "K"]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        want = sorted((m.start(), i, m.end()) for i, (_, rx, ok) in enumerate(base) for m in rx.finditer(t) if ok(m))
        got = [(s.start, secret_scan.KINDS.index(s.kind), s.end) for s in secret_scan.find_spans(t) if s.kind in secret_scan.BASE_KINDS]
        assert got == want, t


def test_secret_checksums():
    good = token("ghp_", "Zy" * 15)
    assert [s.kind for s in secret_scan.find_spans(f"é {good}")] == ["github"] and secret_scan.find_spans(f"é {good}")[0].start == 2
    assert not secret_scan.find_spans("ghp_" + "z" * 36)
    assert [s.kind for s in secret_scan.find_spans("visa 4111 1111 1111 1111")] == ["card"] and not secret_scan.find_spans("visa 4111 1111 1111 1112")
    assert [s.kind for s in secret_scan.find_spans("IBAN: GB82 WEST 1234 5698 7654 32")] == ["iban"]
    assert secret_scan.redact("a visa 4111-1111-1111-1111 b", secret_scan.find_spans("a visa 4111-1111-1111-1111 b")) == "a visa [card] b"
    assert secret_scan.find_spans(None) == [] and secret_scan.redact(None, []) is None


def test_secret_documents(odd, empty):
    out = secret_scan.redact_documents(odd)
    assert out.columns == odd.columns and sorted(str(r.text) for r in out.collect()) == sorted(str(t) for _, t in ROWS)
    assert secret_scan.span_digests(secret_scan.scan_documents(odd)).count() == len(ROWS) and secret_scan.redact_documents(empty).count() == 0


def check_packing(rows, ids):
    by_doc, by_seq = {}, {}
    for d, start, n, crc, total, seq, off in rows:
        by_doc.setdefault(d, []).append((start, n, crc, total))
        by_seq.setdefault(seq, []).append((off, n))
    assert by_doc.keys() == {d for d, x in ids.items() if x}
    for d, pieces in by_doc.items():
        at = 0
        for start, n, crc, total in sorted(pieces):
            assert start == at and total == len(ids[d]) and crc == zlib.crc32(array("I", ids[d][start : start + n]).tobytes())
            at += n
        assert at == len(ids[d])
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at and n > 0
            at += n
    return [sum(n for _, n in p) for p in by_seq.values()], [len(p) for p in by_seq.values()]


@pytest.mark.parametrize("seed", range(6))
def test_packer(seed):
    rng = random.Random(seed)
    ids = {i: [rng.randrange(1000) for _ in range(rng.choice([0, 1, 3, 40, 90, 700]))] for i in range(120)}
    p = packing.Packer(max_tokens=128, max_segments=16, max_loss=128, waiting=20)
    for d, x in ids.items():
        p.add(d, array("I", x).tobytes())
    p.finish()
    sizes, segments = check_packing(p.rows, ids)
    assert max(sizes) <= 128 and max(segments) <= 16 and all(s & (s - 1) == 0 or k == 16 for s, k in zip(sizes, segments))


def test_packer_limits():
    p = packing.Packer(max_tokens=64, max_segments=3, max_loss=20, waiting=10)
    ids = {i: [i] * n for i, n in enumerate([5, 1, 1, 1, 1, 200, 30])}
    for d, x in ids.items():
        p.add(d, array("I", x).tobytes(), loss=len(x) // 2)
    p.finish()
    sizes, segments = check_packing(p.rows, ids)
    assert max(sizes) <= 64 and max(segments) <= 3
    loss = {}
    for d, _, n, _, total, seq, _ in p.rows:
        loss[seq] = loss.get(seq, 0) + n * (len(ids[d]) // 2) / total
    assert max(loss.values()) <= 20 + 1e-6


def test_word_ids_are_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    enc = packing.word_encoder(WORDS).encode
    for x in [*(t or "" for _, t in ROWS), "It's ΣΑΣ İ ǅ é", "é ﬁ ½ 12 ١٢ _a_", "<|endoftext|>", "<|endoftext|> x", "a<|startoftext|><|", "<|END|>", "don't STOP 'LL", "x\x1cy\x85z\xa0 w", "1" * 3000 + "é" * 3000]:
        assert [*array("I", enc(x))] == t.encode(x, add_special_tokens=False).ids, x
    rng = random.Random(5)  # every code point, beside others that could join it
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng.shuffle(points)
    for i in range(0, len(points), 64):
        x = "".join(c + rng.choice(["", "", " ", "a", "'s", "\n", "\u0301", "<|endoftext|>"]) for c in points[i : i + 64])
        assert [*array("I", enc(x))] == t.encode(x, add_special_tokens=False).ids, x


def test_every_limit_binds(spark):
    """Loss and segments stop sequences of instruction data before tokens do."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.choice([1, 2, 30, 90]))), i % 4) for i in range(300)]
    rows = [(i, t, len(t.split()) if kind == 0 else 0 if kind == 1 else len(t.split()) // 3) for i, t, kind in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, loss long").coalesce(1)
    out = packing.pack_documents(df, word_ids, loss_col="loss", max_tokens=256, max_segments=8, max_loss=80, waiting=40).collect()
    enc = packing.word_encoder(WORDS).encode
    sizes, segments = check_packing([tuple(r) for r in out], {i: [*array("I", enc(t))] for i, t, _ in rows})
    bears, loss, n = {i: x for i, _, x in rows}, {}, {}
    for r in out:
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + r.length * bears[r.doc_id] / r.doc_tokens
        n[r.sequence_id] = n.get(r.sequence_id, 0) + 1
    assert max(sizes) <= 256 and max(segments) <= 8 and max(loss.values()) <= 80 + 1e-6
    assert sum(x > 79 for x in loss.values()) > 5 and sum(x == 8 for x in n.values()) > 5


def test_pack_documents(odd, empty):
    rows = [tuple(r) for r in packing.pack_documents(odd.dropDuplicates(["doc_id"]).where("doc_id is not null"), word_ids, end_id=2).collect()]
    enc = packing.word_encoder(WORDS).encode
    texts = {d: t for d, t in ROWS if d is not None}
    sizes, _ = check_packing(rows, {d: [*array("I", enc(t or "")), 2] for d, t in texts.items()})
    assert max(sizes) <= 4096
    assert packing.pack_documents(empty, word_ids, end_id=2).count() == 0
    assert packing.pack_documents(odd, word_ids, end_id=2).groupBy().sum("length").first()[0] == sum(len(enc(t or "")) // 4 + 1 for _, t in ROWS)


def test_winnowing(spark, odd, empty):
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(400)]
    shared = [f"s{i}" for i in range(winnow.W + winnow.K - 1)]
    a, b = " ".join(words[:200] + shared + words[200:250]), " ".join(words[250:300] + shared + words[300:])
    d = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    f = {r.doc_id: {(x["hash"], x["pos"]) for x in r.selected} for r in winnow.fingerprint_documents(d).collect()}
    both = {h for h, p in f[1] if 200 <= p < 211} & {h for h, p in f[2] if 50 <= p < 61}
    assert both  # the guarantee, at the known places
    got = winnow.edited_digests(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    texts = {d: t or "" for d, t in ROWS if d is not None}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        r = next(x for x in got if x.doc_id == k)
        t, nxt = texts[k], texts[order[(i + 1) % len(order)]]
        h = len(t) // 2
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert winnow.edited_digests(odd).count() == len(ROWS) and winnow.edited_digests(empty).count() == 0
    assert winnow.edited_digests(odd.where("doc_id = 1")).first().near_next == 1.0


def test_rightmost_minimum(spark):
    d = spark.createDataFrame([("x " * 40,)], "text string")
    pos = [x["pos"] for x in winnow.fingerprint_documents(d.selectExpr("1 as doc_id", "text")).first().selected]
    assert pos == [*range(winnow.W - 1, 40 - winnow.K + 1)]


def test_quality_held_out(spark, odd, empty):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_evidence(docs, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.keep for r in quality.score_documents(docs, model, "source", "lang").collect()}
    held = [(r.quality == 1) == got[r.doc_id] for r in labels.where("doc_id % 2 = 1").collect()]
    assert np.mean(held) >= 0.9
    out = quality.score_documents(odd, model, "source", "lang")
    assert out.count() == len(ROWS) and out.where("quality is null or keep is null").count() == 0
    assert quality.score_documents(empty, model, "source", "lang").count() == 0
    neutral = quality.fit_evidence(docs, labels.where("false"))
    assert quality.score_documents(odd, neutral, "source", "lang").where("not keep").count() == 0


def test_sparse_sites_shrink(spark):
    rows = [(i, "good " + " ".join(f"w{i * 7 + j}" for j in range(30)), "big") for i in range(60)] + [(99, "zz zz zz zz zz zz", "small")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    x = np.array([quality.features(t) for _, t, _ in rows])
    model = quality.Evidence.fit(x, np.array([1.0] * 60 + [0.0]))
    r = {x.doc_id: x for x in quality.score_documents(d, model, "source", "source").collect()}
    assert r[99].evidence < 0.1 < 0.3 < r[99].host_mean < r[0].host_mean  # one document moves its host only part of the way


def brute_winnow(text):
    """(hash, position) of selected grams, window by window."""
    import struct

    import xxhash

    def joined(a, b):
        return xxhash.xxh64_intdigest(struct.pack("<Q", b), seed=xxhash.xxh64_intdigest(struct.pack("<Q", a), seed=42))

    tokens = re.findall(winnow.TOKEN, text or "")
    one = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tokens]
    if len(one) < winnow.K:
        return None  # one hash of all tokens
    two = [joined(a, b) for a, b in zip(one, one[1:])]
    grams = [joined(a, b) >> 32 for a, b in zip(two, two[2:])]
    out = []
    for s in range(max(len(grams) - winnow.W, 0) + 1):
        window = range(s, min(s + winnow.W, len(grams)))
        best = min(window, key=lambda i: (grams[i], -i))
        if not out or out[-1] != (grams[best], best):
            out.append((grams[best], best))
    return out


def test_winnowing_without_spaces(spark):
    """One character in front of text without spaces moves no token but the first: Thai, a long URL, base64, CJK."""
    rng = random.Random(9)
    make = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = {1: make("กขคงจฉชซญดตถทนบปผฝพฟมยรลวสหอ", 909), 2: "https://x.org/" + make("abcdef/?=&-0123456789", 500), 3: make("ABCxyz0189+/", 2000), 4: make("日本語文字列漢学", 300), 5: make("𝔄𝔅𝔇𝔈𝔉", 200)}
    rows = [(10 * i + k, ("X" if k else "") + t) for i, t in texts.items() for k in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: r.fp for r in df.select("doc_id", winnow.winnow(F.col("text")).alias("fp")).collect()}
    both = spark.createDataFrame([(i, fp[10 * i], fp[10 * i + 1]) for i in texts], "i long, a array<long>, b array<long>")
    assert all(r.x > 0.9 for r in both.select(winnow.likeness(F.col("a"), F.col("b")).alias("x")).collect())
    got = {r.doc_id: [(x["hash"], x["pos"]) for x in r.selected] for r in winnow.fingerprint_documents(df).collect()}
    assert got == {i: brute_winnow(t) for i, t in rows}


def test_packer_odd_losses():
    """Losses below 0, above an example's tokens and beyond the limit pack and end."""
    p = packing.Packer(max_tokens=64, max_segments=3, max_loss=20, waiting=3)
    ids = {i: [*range(n)] for i, n in enumerate([1, 30, 64, 200, 5, 7, 40])}
    for (i, x), loss in zip(ids.items(), [10_000, -5, 10**9, None, 0, 3, 40]):
        p.add(i, array("I", x).tobytes(), loss)
    p.finish()
    check_packing(p.rows, ids)


def test_winnowing_is_brute_force(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["a", "b", "cc", "日本", "d" * 20]) for _ in range(rng.randrange(90))) for i in range(60)} | {70: "x " * 200, 71: "日" * 50}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: [(x["hash"], x["pos"]) for x in r.selected] for r in winnow.fingerprint_documents(df).collect()}
    want = {i: brute_winnow(t) for i, t in texts.items()}
    assert sum(w is not None for w in want.values()) > 50
    for i, w in want.items():
        assert got[i] == w if w is not None else len(got[i]) == bool(texts[i])
    near = {r.doc_id: r for r in winnow.edited_digests(df).collect()}
    order = sorted(texts, reverse=True)
    alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, k in zip(order, order[1:] + order[:1]):
        assert near[i].near_next == pytest.approx(alike({h for h, _ in got[i]}, {h for h, _ in got[k]}))


def test_posterior_is_brute_force(spark):
    """Priors by moments, shrinkage and the left-out share, computed document by document."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["good", "text", "zz", "9", "!!"]) for _ in range(rng.randrange(1, 40))), h := rng.choice("aabc"), rng.choice("xy") + h) for i in range(300)] + [(900, "only one", "d", "zd"), (901, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    x = np.array([quality.features(t) for _, t, _, _ in rows])
    model = quality.Evidence.fit(x, np.array([float("good" in (t or "")) for _, t, _, _ in rows]))
    p = model.predict(x)
    hosts, paths = {}, {}
    for q, (_, _, h, k) in zip(p, rows):
        hosts.setdefault(h, []).append(q)
        paths.setdefault((h, k), []).append(q)
    mean = p.mean()

    def strength(groups, centre):
        n = sum(map(len, groups.values()))
        spread = sum(len(v) * (np.mean(v) - centre(g)) ** 2 for g, v in groups.items())
        noise = sum(centre(g) * (1 - centre(g)) for g in groups)
        within = sum(len(v) * centre(g) * (1 - centre(g)) for g, v in groups.items()) / n
        return min(max(within / max((spread - noise) / n, 1e-6) - 1, 1.0), 1e6)

    kh = strength(hosts, lambda g: mean)
    host_mean = {h: (sum(v) + kh * mean) / (len(v) + kh) for h, v in hosts.items()}
    kp = strength(paths, lambda g: host_mean[g[0]])
    logit = lambda v: np.log((w := min(max(v, 1e-9), 1 - 1e-9)) / (1 - w))
    got = {r.doc_id: r for r in quality.score_documents(df, model, "host", "path").collect()}
    for q, (d, _, h, k) in zip(p, rows):
        v = paths[h, k]
        prior = (sum(v) - q + kp * host_mean[h]) / (len(v) - 1 + kp)
        odds = logit(q) + logit(prior) - logit(mean)
        assert (got[d].evidence, got[d].host_mean, got[d].path_mean) == (pytest.approx(q), pytest.approx(host_mean[h]), pytest.approx(prior))
        assert got[d].quality == pytest.approx(1 / (1 + np.exp(-odds)), rel=1e-6) and got[d].keep == (got[d].quality >= 0.5)
