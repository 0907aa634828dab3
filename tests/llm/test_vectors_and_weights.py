"""Whitening, importance resampling and packing against brute force, and on hard cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from sievespark.llm import common, langid, packing, resample, whitening

VECTORS = "vec_id long, embedding array<double>"
PATH = public_tokenizers.path("word_bpe_49k.json")


def components_of(x, k=4):
    """By a full eigendecomposition, with the centre."""
    centre = x.mean(0)
    values, vectors = np.linalg.eigh((x - centre).T @ (x - centre) / len(x))
    return values[::-1][:k], vectors[:, ::-1][:, :k], centre


@pytest.mark.parametrize(("dim", "kept"), [(24, 12), (3, 12), (90, 3)])
def test_whitening(spark, monkeypatch, dim, kept):
    monkeypatch.setattr(whitening, "KEPT", kept)  # a small basis is cut back often
    rng = np.random.default_rng(dim)
    v = rng.standard_normal((400, dim)) * np.linspace(2, 0.5, dim) ** (2 if dim == 90 else 1) + 3
    v[100:230] = v[7]  # a third of the rows
    v[5] = -0.0
    bad = [None, [], [float("nan")] * dim, [1.0, None] * (dim // 2) + [1.0] * (dim % 2), [float("-inf")] * dim, [1.0] * (dim + 1)]
    rows = [(i, c.tolist()) for i, c in enumerate(v)] + [(1000 + i, b) for i, b in enumerate(bad)] + [(None, v[3].tolist()), (3, v[3].tolist())]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("n", "i", "x", "v", "y0", "component", "count")})
    out = whitening.whiten(df).collect()
    x = np.floor(256 * v).astype(int)
    fit = np.unique(x, axis=0)
    n, sums, k = len(fit), fit.sum(0), min(4, dim)
    values, vectors, centre = components_of(fit.astype(float))
    total = np.trace(np.cov(fit.T, bias=True))
    got = {(r["vec_id"], r["component"]): r for r in out if r["vec_id"] not in (None, 3)}
    assert len(out) == 402 * k and len(got) == 399 * k
    again = {i: sorted(r["whitened"] for r in out if r["vec_id"] == i) for i in (None, 3)}
    assert sorted(again[None] * 2) == again[3]
    for c in range(k):
        want = (x - centre) @ vectors[:, c] / np.sqrt(values[c])
        here = np.array([got[i, c + 1]["whitened"] for i in range(400) if i != 3])
        sign = np.sign(here @ np.delete(want, 3))
        assert np.abs(sign * here - np.delete(want, 3)).max() < 1e-8
    assert all(r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - values[r["component"] - 1] / total) < 1e-12 for r in out)
    assert all(got[i, 1]["deviation"] == int(((n * x[i] - sums) ** 2).sum()) for i in range(400) if i != 3)


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], VECTORS)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], VECTORS)
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}
    twin = whitening.whiten(spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1.0])], VECTORS)).collect()
    assert {round(r["explained"], 12) for r in twin} == {0.5} and max(r["identity_error"] for r in twin) < 1e-12
    large = spark.createDataFrame([(0, [1e13, 0.0]), (1, [-1e13, 1.0])], VECTORS)
    with pytest.raises(Exception, match="Overflow|int too big|too large"):
        whitening.whiten(large).collect()


def test_exact_deviations(spark):
    """Squares beyond 2^62 in their bound, but not in their sum, are exact."""
    rows = [(i, [float((1 << 20) + i * 1000), float(i)]) for i in range(9)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS), 1).collect()
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert sorted(r["deviation"] for r in out) == sorted(sum((9 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x)


def brute_resample(docs, target, run, buckets, least, percent, seed):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, run + 1) for i in range(len(w) - n + 1)]

    found = [features(t) for _, t in docs]
    s, t = Counter(b for _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    whole, aim = sum(s.values()), sum(t.values())
    out = []
    for (doc_id, _), (n, f) in zip(docs, found, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (whole + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in f]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain) // len(gain) if gain else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return sorted(map(str, (r[:5] for r in out)))


@pytest.mark.parametrize(("run", "buckets", "least", "percent", "span"), [(1, 10_000, 20, 10, 100_000), (2, 50, 3, 40, 7), (1, 3, 0, 100, 5)])
def test_resampling(spark, monkeypatch, run, buckets, least, percent, span):
    monkeypatch.setattr(resample, "RANGE", span)
    random.seed(buckets)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "don't", "中文", "A1", "x_y", "😀"]
    docs = [(i, " ".join(random.choices(vocabulary, k=random.randrange(1, 60)))) for i in range(150)]
    docs += [(i, docs[0][1]) for i in range(200, 280)] + [(7, docs[7][1])] * 30 + [(None, docs[9][1])] * 20 + [(300, None), (301, ""), (302, " .,- "), (None, None), (303, "long " * 50_000)]
    target = ["w1 w2 w3 É", None, "", "w1 w1 A1"]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("rank", "score", "weight", "words", "ids", "tie", "at", "key", "n")}).repartition(5)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, key int")
    out = resample.resample(frame, aim, run, buckets, least, percent).collect()
    assert sorted(str([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in out) == brute_resample(docs, target, run, buckets, least, percent, resample.SEED)


def test_resampling_without_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs).count() == 0
    assert resample.resample(docs, docs.limit(0), least=1, percent=100).first()["rank"] == 1


def test_csr_blocks(spark, monkeypatch):
    monkeypatch.setattr(resample, "ROWS", 2)
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b")], "doc_id long, text string").coalesce(1)
    blocks = resample.matrix(docs).collect()
    a, b = (zlib.crc32(w) % 10_000 for w in (b"a", b"b"))
    assert [(r["ids"], r["words"], r["indptr"]) for r in blocks] == [([1, 2], [3, 0], [0, 2, 2]), ([3], [1], [0, 1])]
    assert dict(zip(blocks[0]["indices"], blocks[0]["counts"], strict=True)) == {a: 2, b: 1}


def test_cuts():
    for n in [*range(1, 3000), 10_000, 123_457]:
        found = packing.cuts(n)
        assert [s for s, _ in found] == [sum(length for _, length in found[:i]) for i in range(len(found))] and sum(length for _, length in found) == n
        assert all(2048 % length <= 45 for _, length in found) and len(found) <= n // 2048 + 6


@pytest.mark.parametrize(("fan", "parts"), [(8, 1), (2, 7)])
def test_packing(spark, monkeypatch, fan, parts):
    monkeypatch.setattr(packing, "FAN", fan)
    monkeypatch.setattr(packing, "CACHED", 300)
    random.seed(fan)
    vocabulary = ["the", "Straße", "don't", "it's", "中文字", "İstanbul", "é", "́", "123", "x\ty", "a b", "n\r\nm", "q\x1cr", " ", "😀!", "antidisestablishmentarianism", "<|endoftext|>", "y" * 90]
    docs = [(i, "".join(random.choice(vocabulary) + random.choice([" ", "  ", "\n", ""]) for _ in range(random.randrange(1, 900)))) for i in range(60)]
    docs += [(i, "same copies here") for i in range(100, 140)] + [(3, docs[3][1])] * 3 + [(None, "no id"), (None, None), (200, ""), (201, " \n "), (202, "long " * 30_000 + "x" * 9000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("start", "ids", "offset", "length", "p")}).repartition(parts)
    rows = packing.pack(frame, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in docs)
    # every document is made of its pieces, and no id lies in two: per id, the multiset of pieces is that of some cutting of each of its documents
    pieces = Counter()
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids)
        pieces.update((r["doc_id"], r["doc_tokens"], r["start"] + i, int(x)) for i, x in enumerate(ids))
    each = Counter()
    for (doc_id, ids), n in want.items():
        for i, x in enumerate(ids):
            each[doc_id, len(ids), i, x] += n
    assert pieces == each
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], len(r["ids"]) // 4))
    padding = 0
    for found in sequences.values():
        found.sort()
        ends = np.cumsum([n for _, n in found])
        assert [o for o, _ in found] == [0, *ends[:-1]] and ends[-1] <= 2048
        padding += 2048 - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    assert padding <= 0.005 * sum(map(len, (r["ids"] for r in rows))) / 4
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_chunks_know_what_the_tokenizer_knows():
    """Texts cut at blanks have the ids of whole texts, for every code point beside and between blanks."""
    whole, chunks = Tokenizer.from_file(PATH), packing.Chunks(Tokenizer.from_file(PATH))
    points = [chr(c) for c in [*range(0x3100), *range(0xA640, 0xAC10), *range(0xF900, 0x10000), *range(0x1F5F0, 0x1F610)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a {p} {p}b'{p} é" for p in points[i : i + 400]) for i in range(0, len(points), 400)]
    assert [chunks.encode(t) for t in texts] == [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert os.environ.get("TOKENIZERS_PARALLELISM") in (None, "false")


def test_smallest_hashes(spark):
    """The bounded samples of the fitted operators: just the rows of the smallest hashes, also where more than the bound lie under the first threshold's expectation."""
    df = spark.range(5000).repartition(9)
    h = F.xxhash64("id")
    want = [r["id"] for r in df.orderBy(h).limit(300).collect()]
    assert [r["id"] for r in common.smallest(df, h, 300).collect()] == want
    assert common.smallest(df, h, 5000).count() == 5000 and common.smallest(df, h, 4990).count() == 4990 and common.smallest(df.limit(0), h, 3).count() == 0
    same = spark.createDataFrame([(7,)] * 100, "id long")
    assert common.smallest(same, h, 10).count() == 10


def test_only_letters_speak_for_a_language():
    assert len(langid.trigrams("— “ ” – … 😀 12 !?")) == 0 and len(langid.trigrams("été")) == 3 and len(langid.trigrams("中文")) == 2
