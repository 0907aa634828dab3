"""Operators over documents against brute force, and on hard cases: nulls, empty and very long texts, ties, repeated rows, no rows, clashing names."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from sievespark.llm import bpe, common, langid, line_dedup, media, mixing, pii, simhash, toxicity

random.seed(5)
VOCABULARY = [f"w{i}" for i in range(400)]
LONG = " ".join(random.choices(VOCABULARY, k=20_000))
COPY = " ".join(random.choices(VOCABULARY, k=120))
NEAR = COPY.replace(COPY.split()[60], "changed", 1)
TEXTS = [
    (0, None, "a"), (1, "", "a"), (2, "  \n\t ", None), (3, LONG, "b"), (4, COPY, "b"), (5, COPY, "b"), (6, NEAR, "a"), (6, NEAR, "a"), (7, COPY.upper(), "c"),
    (8, "one\ntwo\nthree\nfour", "c"), (9, "zero\none\ntwo\nthree\nfour\nfive", "b"), (10, "one two", "é"), (11, "İé中😀 it's\r\n  x\x1cy 12²", "é"), (None, "one\ntwo\nthree", None), (None, "word", "a"),
]
CLASHING = ("n", "h", "size", "target", "copies", "taken", "node", "component", "text_hash", "__h", "copy", "lines_removed", "page_id", "held_out", "score", "fp", "first", "group", "code")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "en") for i, t, s in TEXTS], "doc_id long, text string, source string, lang string").withColumns({c: F.lit(7) for c in CLASHING}).repartition(3)


def words(text):
    return (text or "").encode().lower().split()


def brute_simhash(text, size=3):
    w = words(text)
    total, n = [0] * 64, 0
    for i in range(max(0, len(w) - size + 1) if len(w) >= size else bool(w)):
        h = xxhash.xxh64_intdigest(b" ".join(w[i : i + size]), 42)
        n += 1
        for b in range(64):
            total[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * total[b] > n)


def test_simhash(spark, docs):
    rows = simhash.components(docs).collect()
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64) for r in rows) == sorted((str(i), brute_simhash(t)) for i, t, _ in TEXTS)
    fps = {r["fp"] % 2**64: set() for r in rows}
    for r in rows:
        fps[r["fp"] % 2**64].add(r["doc_id"])
    reach = {a: {a} for a in fps}
    for _ in fps:
        for a in fps:
            reach[a] |= {c for b in reach[a] for c in fps if (b ^ c).bit_count() <= 2}
    for r in rows:
        ids = [i for b in reach[r["fp"] % 2**64] for i in fps[b] if i is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    assert simhash.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 5])
def test_hamming_links_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) for _ in range(3)], base[:1] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.hamming_links(df).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    forest = {int(x): int(x) for x in fps}

    def root(links):
        up = dict(forest)

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        groups = {}
        for x in up:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))

    every = [(int(a), int(b)) for a in fps for b in fps if a < b and int(a ^ b).bit_count() <= 2]
    assert root(edges) == root(every)


@pytest.mark.parametrize(("kind", "hub", "keys"), [("long", 200, 20_000), ("long", 5, 20_000), ("struct<doc_id: bigint, text_hash: bigint>", 1, 20)])
def test_components_keep_estimated_sizes_short(spark, monkeypatch, kind, hub, keys):
    """Spark takes a join's size to be a product and a checkpoint hands it on: joins of a round's own tables multiply its digits, which filled the driver's memory."""
    monkeypatch.setattr(common, "HUB", hub)
    monkeypatch.setattr(common, "HOT_KEYS", keys)
    rng = random.Random(3)
    ids = rng.sample(range(10**6), 120)
    edges = [*zip(ids[:50], ids[1:51], strict=True), *((ids[60], x) for x in ids[61:90]), *((ids[90], x) for x in ids[61:70]), *((ids[100 + i], ids[100 + rng.randrange(i + 1)]) for i in range(20))]
    node = (lambda x: x) if kind == "long" else lambda x: (None if x == ids[7] else x // 1000, x)  # a null id comes first
    rng.shuffle(edges)
    edges = [(node(a), node(b)) for a, b in edges]
    bits = []

    def checkpoint(df):
        out = common.checkpointed(df)
        bits.append(out._jdf.queryExecution().analyzed().stats().sizeInBytes().bit_length())
        assert bits[-1] < 500, bits
        return out

    found = common.connected_components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), checkpoint).collect()
    order = lambda x: x if kind == "long" else (x[0] is not None, x[0] or 0, x[1])
    reach = {x: {x} for e in edges for x in e}
    for a, b in edges:
        both = reach[a] | reach[b]
        reach |= dict.fromkeys(both, both)
    want = {x: min(group, key=order) for x, group in reach.items() if len(group) > 1}
    assert sorted(((tuple(r[0]), tuple(r[1])) if kind != "long" else tuple(r) for r in found), key=str) == sorted(want.items(), key=str)


def test_near_duplicates(spark, docs):
    found = {(r["doc_id"], r["group_doc_id"]) for r in simhash.near_duplicates(docs).where("doc_id >= 3").collect()}
    assert {(4, 4), (5, 4), (6, 4), (7, 4), (3, 3), (8, 8)} <= found
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == [0, 3, 4, 8, 9, 10, 11]
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_near_duplicates_meet_by_the_tree(spark, docs, monkeypatch):
    """The tree over fingerprints is a step of the pipeline's stage: with its links alone, texts that differ in few words of many are still found."""
    rng = random.Random(5)
    words = [[f"w{rng.randrange(10**6)}" for _ in range(3000)] for _ in range(6)]
    rows = [(2 * i + j, " ".join([*w[:-1], "other"] if j else w)) for i, w in enumerate(words) for j in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, tree = [], simhash.linked_prints
    monkeypatch.setattr(simhash, "linked_prints", lambda chosen: seen.append(tree(chosen).checkpoint()) or seen[-1])
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [0, 2, 4, 6, 8, 10]
    fps = {r["doc_id"]: (r["fp"], r["component_id"]) for r in simhash.components(df).collect()}
    met = {r["doc_id"]: r["key"] for r in seen[0].select("node.doc_id", "key").collect()}
    assert met.keys() == fps.keys()
    assert all((met[a] == met[b]) == (fps[a][1] == fps[b][1]) for a in met for b in met)
    assert sum(fps[a][1] == fps[a + 1][1] for a in range(0, 12, 2)) >= 3


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 3)
    rows = [(i, COPY + f" tail{i}") for i in range(12)] + [(50, LONG)]
    out = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 50]


@pytest.fixture
def grouped_rows(monkeypatch):
    """Runs a frame and returns the most rows that one call of applyInPandas sees in it."""
    kind = type(SparkSession.builder.getOrCreate().range(0).groupBy())
    original, planned = kind.applyInPandas, []

    def noted(self, func, schema):
        planned.append(self)
        return original(self, lambda pdf: func(pdf), schema)

    def most(run):
        monkeypatch.setattr(kind, "applyInPandas", noted)
        run().count()
        monkeypatch.setattr(kind, "applyInPandas", original)
        return max(g.count().agg(F.max("count")).first()[0] for g in planned)

    return most


def test_no_task_of_a_large_cell_sees_more_than_two_blocks(spark, monkeypatch, grouped_rows):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 60)
    monkeypatch.setattr(simhash, "groups_for", lambda n: 1)
    fps = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 2000, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").checkpoint()
    # dealt by hash, so a block of 16 may hold some more; a cell has up to 200 at home, which the last block held before
    assert grouped_rows(lambda: simhash.hamming_links(df)) <= 100


def shingles(text, size=5):
    w = words(text)
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_groups(rows, least=0.8):
    """The smallest id of each id's component of pairs that similar, or of equal words."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                x, y = root[i], root[j]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return root


def families(rng, n, size, changes):
    """Texts that differ from one of n bases in some of their words: similarities lie on both sides of 0.8."""
    rows = []
    for f in range(n):
        base = rng.choices(VOCABULARY, k=size)
        for k in changes:
            text = list(base)
            for at in rng.sample(range(size), k):
                text[at] = f"x{rng.random()}"
            rows.append((100 * f + len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("members", [2048, 4])
def test_near_duplicates_around_the_threshold(spark, monkeypatch, members):
    monkeypatch.setattr(simhash, "MEMBERS", members)
    rng = random.Random(7)
    rows = families(rng, 8, 150, (0, 1, 2, 2, 3, 3, 4, 5, 9)) + [(10_000 + i, t) for i, t in families(rng, 20, 9, (0, 0, 1, 1))] + [(20_000 + i, COPY[: 400 + i]) for i in range(0, 200, 5)]
    got = {r["doc_id"]: r["group_doc_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_no_task_of_a_large_group_sees_more_than_two_blocks(spark, monkeypatch, grouped_rows):
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    rng = random.Random(9)
    rows = [(i, f"{COPY} " + " ".join(f"y{rng.random()}" for _ in range(45))) for i in range(300)]  # half alike: they meet, but no two are near-duplicates
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert grouped_rows(lambda: simhash.near_duplicates(df)) <= 4 * 16 * 12  # small buckets share tasks of some 2,000 rows in all
    assert simhash.one_of_each(df).count() == 300


def test_parity_codes_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 30)).astype(np.uint64)]))
        gap = int(np.bitwise_count(simhash.parity_code(a) ^ simhash.parity_code(b)).sum()) if len(b) else 0
        assert gap <= len(np.setxor1d(a, b))


def test_line_dedup(spark, docs):
    out = {(r["doc_id"], r["text"]): r["lines_removed"] for r in line_dedup.dedup_lines(docs).collect()}
    assert out[(None, "one\ntwo\nthree")] == 0
    assert out[(8, "four")] == 3 and out[(9, "zero\nfive")] == 4
    assert out[(0, None)] == 0 and out[(1, "")] == 0 and out[(3, LONG)] == 0
    assert sum(r["lines_removed"] for r in line_dedup.dedup_lines(docs).collect()) == 7
    twice = spark.createDataFrame([(1, "a\nb\nc\na\nb\nc\na\nb"), (1, "a\nb\nc\na\nb\nc\na\nb")], "doc_id long, text string")
    assert [(r["text"], r["lines_removed"]) for r in line_dedup.dedup_lines(twice).collect()] == [("a\nb\nc", 5)] * 2
    passage = "here is the first sentence of a passage, and a second part of it. The third one ends it here."
    inside = spark.createDataFrame([(1, f"An opening of one kind, {passage} One end, of so many words that the line is long."), (2, f"Quite another beginning. {passage} Another end; with more words so that it is long too."), (3, "a, b, c, d and"), (4, "a, b, c, d or")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(inside).collect()}
    assert passage in out[1] and out[2] == "Quite another beginning. Another end; with more words so that it is long too." and (out[3], out[4]) == ("a, b, c, d and", "a, b, c, d or")
    many = spark.createDataFrame([(1, "\n".join(f"line {i} of many" for i in range(4000))), (2, "\n".join(f"line {i} of many" for i in range(1000, 3000)) + "\nlast")], "doc_id long, text string")
    assert {r["doc_id"]: r["lines_removed"] for r in line_dedup.dedup_lines(many).collect()} == {1: 0, 2: 2000}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tokenizer():
    with open(bpe.vocabulary(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, docs, tokenizer):
    rows = bpe.encoded(docs, bpe.vocabulary(), ids=True).collect()
    want = Counter((i, tuple(tokenizer.encode_ordinary(t or ""))) for i, t, _ in TEXTS)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    text = {tuple(tokenizer.encode_ordinary(t or "")): (t or "").encode() for _, t, _ in TEXTS}
    for r in rows:
        raw = text[tuple(r["ids"])]
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        ends = [*r["offsets"][1:], len(raw)]
        assert b"".join(raw[a:b] for a, b in zip(r["offsets"], ends)) == raw
    assert bpe.encoded(docs.limit(0), bpe.vocabulary()).count() == 0


def test_bpe_boundaries(tokenizer):
    parts = ["a", "s", "t", "re", "ve", "ll", "d", "m", "'", " ", "\n", " ", "é", "1", "²", "!", "中", "\t", "'s", "  ", "\x1c", "́", "😀", "R"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(3000)] + ["a" * 3000, "ab" * 2000 + "!" * 3000, " " * 1000]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.encode(texts, bpe.vocabulary())] == [tokenizer.encode_ordinary(t) for t in texts]


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_spans(t):
    def luhn(g):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(g[::-1]))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(t)]
    out += [("ip", *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 16 <= len(g := re.sub("[ -]", "", m[0])) <= 19 and luhn(g)]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii_base_spans():
    parts = ["a", ".", "@", "1", "2", "25", "256", "+", "4", "-", " ", "(", ")", "b.c", "é", "\n", "4111 1111 1111 1111", "@x.y"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 30))) for _ in range(20000)]
    assert [",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(t)) for t in texts] == [brute_spans(t) for t in texts]


def test_pii_bootstrapping(spark, docs):
    cards = ["4929348385146306", "4952935900253052", "4417744280351547", "4845168114407329"]
    rows = [(i, f"hello there my number {i * 7919 % 900000} ok and card no. {cards[i % 4]} bye") for i in range(12)]
    rows += [(100, "first\npay card no. 1234567890123450 now"), (200, None), (201, ""), (201, "")]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), seeds_needed=3).collect()}
    assert out[100]["spans"] == "card:19:35" and out[100]["base"] == "" and out[100]["n_card"] == 0
    assert out[0]["spans"] == out[0]["base"] == brute_spans(rows[0][1]) and out[200]["spans"] == ""
    assert pii.personal_data(docs).count() == len(TEXTS) and pii.personal_data(docs.limit(0)).count() == 0


def test_pii_bootstrapping_over_blanks_and_punctuation(spark):
    spaced = ["4929 3483 8514 6306", "4952 9359 0025 3052", "4417 7442 8035 1547", "4845 1681 1440 7329"]
    rows = [(i, f"please ring us on +1 (0{17 + i}) 555-77{10 + i} today") for i in range(6)]
    rows += [(20 + i, f"and card no. {spaced[i]}, bye") for i in range(4)]
    rows += [(40 + i, f"write mail to: user{i}@mail.org, or wait") for i in range(6)]
    rows += [(100, "ring us on (017) 555-7713, please"), (101, "pay card no. 1234 5678 9012 3450. Now"), (102, "mail to: \"some.body@host\", ok")]
    out = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), seeds_needed=3).collect()}
    found = {i: [t[int(a) : int(b)] for _, a, b in (s.split(":") for s in out[i]["spans"].split(","))] if out[i]["spans"] else [] for i, t in rows}
    assert found[100] == ["(017) 555-7713"] and found[101] == ["1234 5678 9012 3450"] and found[102] == ["some.body@host"]
    assert all(out[i]["spans"] == out[i]["base"] != "" for i, _ in rows if i < 100) and all(out[i]["base"] == "" for i in (100, 101, 102))


@pytest.mark.parametrize("text, span", [("4225039295678253!!", "4225039295678253"), ("(4225039295678253)", "4225039295678253"), ("4225039295678253 12 x", "4225039295678253"), ("a@b.c, 12", "a@b.c"), ("+ 1 555 7713 x", "+ 1 555 7713"), ("+1 (017) 555-7713.", "+1 (017) 555-7713"), ("1234  5678", "1234")])
def test_pii_candidates(text, span):
    a, b = pii.candidate(text, [m.span() for m in re.finditer(r"\S+", text)], 0)
    assert text[a:b] == span


def test_pii_keeps_all_patterns(spark, monkeypatch):
    cards = ["4929348385146306", "4952935900253052", "4417744280351547", "4845168114407329"]
    rows = [(i, f"of the {cards[i % 4]} bye") for i in range(8)] + [(20 + i, f"of the host 10.0.0.{i} up") for i in range(6)] + [(30 + i, "of the town") for i in range(30)]
    rows += [(60 + i, f"card no. {c} bye") for i, c in enumerate(cards[:3])] + [(100, "card no. 1234567890123450 now"), (101, "the host 99.99.99.999 up"), (200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(tuple(r) for r in pii.personal_data(df, seeds_needed=3).drop("base").collect())
    monkeypatch.setattr(pii, "PATTERNS", 1)
    monkeypatch.setattr(pii, "COUNTED", 5)
    got = sorted(tuple(r) for r in pii.personal_data(df, seeds_needed=3).drop("base").collect())
    assert got == want and {r[0]: r[-2] for r in got}[100] == "card:9:25"


def brute_personal_data(texts, seeds_needed, least):
    """{id: (spans, secrets)}: the same graph, scored with dictionaries."""
    spans, places, totals = {}, {}, Counter()
    for i, t in texts.items():
        spans[i] = pii.base_spans(t)
        hidden = [h for h in pii.secrets(t) if not any(h[1] < b and a < h[2] for _, a, b in spans[i])]
        places[i] = pii.candidates(t, spans[i] + hidden)
        for words in (line.lower().split() for line in t.split("\n")):
            totals.update(f"{words[k - 1]} {words[k]}" for k in range(1, len(words) - 1))
    edges = Counter((p, texts[i][a:b]) for i in texts for _, p, a, b, _ in places[i])
    known = {(k, texts[i][a:b]): 1.0 for i in texts for k, _, a, b, _ in places[i] if k >= 0}
    while True:
        held = {}
        for (p, x), n in edges.items():
            for k in range(5):
                if (k, x) in known:
                    held.setdefault((k, p), []).append(n * known[k, x])
        worth = {kp: sum(v) / totals[kp[1]] for kp, v in held.items() if len(v) >= seeds_needed}
        doubt = {}
        for p, x in edges:
            for k in range(5):
                if (k, p) in worth:
                    doubt[k, x] = doubt.get((k, x), 0.0) + math.log(max(1 - worth[k, p], 1e-6))
        more = {kx: 1 - math.exp(d) for kx, d in doubt.items() if 1 - math.exp(d) >= least}
        had = len(known)
        known = {kx: max(known.get(kx, 0.0), more.get(kx, 0.0)) for kx in known.keys() | more.keys()}
        if len(known) == had:
            break
    best = {}
    for (k, p), w in worth.items():
        if w >= least and (p not in best or (w, -k) > best[p]):
            best[p] = (w, -k)
    out = {}
    for i in texts:
        new = {(-best[p][1], a, b) for k, p, a, b, free in places[i] if p in best and ((k < 0 and free) or (k == 4 and best[p][1] == -4))}
        show = lambda found: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))
        out[i] = (show(spans[i] + [x for x in new if x[0] < 4]), show([x for x in new if x[0] == 4]))
    return out


def test_pii_equals_brute_force(spark):
    """On the documents of a table, and on lines that lead from known instances to new patterns and further instances."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    codes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(12)]
    lines = [f"the api key {c} was lost" for c in codes[:6]] + ["the api key 12345abc67890 was lost", f"just some {codes[7]} here"]
    lines += [f"ring number +4420794600{i:02d} now" for i in range(12)] + [f"ring number 02079-4611{i:02d} now" for i in range(3)] + [f"desk line 02079-4611{i:02d} please" for i in range(3)] + ["desk line 99999-12345 please"]
    texts |= {10**6 + i: x for i, x in enumerate(lines)}
    got = pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), seeds_needed=3)
    got = {r["doc_id"]: (r["spans"], r["secrets"]) for r in got.collect()}
    assert got == brute_personal_data(texts, 3, pii.WORTH)
    assert got[10**6][1] == "secret:12:44" and got[10**6 + 6] == ("", "secret:12:25") and got[10**6 + 7] == ("", "")
    assert got[10**6 + 26][0] == "phone:10:21"


def test_media(spark, docs):
    rows = media.media_columns(docs).collect()
    assert len(rows) == len(TEXTS)
    known = {}
    for _, t, _ in TEXTS:
        raw = (t or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        known[hashlib.sha256(payload).hexdigest()] = (len(payload), len(payload) + 44, zlib.crc32(payload[-16:]))
    assert all(known[r["payload_sha256"]] == (r["payload_bytes"], r["media_bytes"], r["tail_crc32"]) for r in rows)
    assert {r["doc_id"]: r["n_bytes"] for r in rows}[3] == len(LONG)
    assert media.media_columns(docs.limit(0)).count() == 0


def test_chunks_are_content_defined():
    a, b = random.randbytes(60_000), random.randbytes(777)
    one, two = media.chunks(a), media.chunks(b + a)
    assert b"".join(one) == a and b"".join(two) == b + a
    assert len(set(one) & set(two)) > 0.8 * len(one) and all(len(c) <= media.MOST for c in two)
    assert media.cuts(b"x") == [1] and media.from_wav(media.to_wav(b"abc")) == b"abc"
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"abc")[:-1])


def test_languages(spark):
    en, fr = "the thing of that and this with other things they have", "les choses que nous avons dans la maison avec une autre"
    rows = [(i, en + f" {i}", "en", "a") for i in range(20)] + [(100 + i, fr + f" {i}", "fr", "b") for i in range(20)]
    rows += [(200, None, "en", "a"), (201, "", None, None), (202, "123 456 !", "en", "a"), (203, en, None, None), (203, en, None, None), (204, fr, "en", "a"), (205, (fr + " ") * 5000, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit(1) for c in ("host", "belief", "prior", "n", "text_hash", "accepted")})
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert [out[i]["lang"] for i in (0, 100, 203, 205)] == ["en", "fr", "en", "fr"]
    assert not any(out[i]["accepted"] for i in (200, 201, 202)) and out[200]["lang"] is None
    kept = langid.keep_accepted(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    pages = spark.createDataFrame([(1, "https://blog.x.org/fr/1", f'<html lang="fr"><script>the of and</script><p>{fr}</p></html>'), (2, None, None), (3, "nonsense", "")], "page_id long, url string, html string")
    seen = {r["page_id"]: r for r in langid.identify(df, pages).where("page_id is not null").collect()}
    assert (seen[1]["lang"], seen[1]["host"], seen[1]["suffix"], seen[1]["declared"]) == ("fr", "blog.x.org", "org", "fr") and not seen[2]["accepted"] and not seen[3]["accepted"]
    assert langid.keep_accepted(df.limit(0)).count() == 0


def test_undetermined_and_hidden_languages(spark):
    rng = random.Random(2)
    en, fr = "the thing of that and this with other they have".split(), "les choses que nous avons dans la maison une autre".split()
    text = lambda words: " ".join(rng.choices(words, k=30))
    rows = [(i, text(en), "en" if i < 150 else None, "a") for i in range(200)] + [(1000 + i, text(fr), "fr" if i < 150 else None, "b") for i in range(200)]
    rows += [(5000, "人人生而自由在尊严和权利上一律平等" * 4, None, "a"), (5001, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=6)) for _ in range(40)), None, "b")]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i]["lang"] == ("en" if i < 1000 else "fr") and out[i]["accepted"] for i, *_ in rows if i < 5000)  # a quarter of them judged without a label
    assert not out[5000]["accepted"] and not out[5001]["accepted"]


def test_maximal_segments():
    assert toxicity.maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0])) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]
    assert toxicity.maximal_segments(np.zeros(0)) == []


def brute_segments(s, at=0):
    """The best run of scores, then the same on both sides of it."""
    best = max(((sum(s[i:j]), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    return brute_segments(s[: best[1]], at) + [(at + best[1], at + best[2])] + brute_segments(s[best[2] :], at + best[2])


def test_maximal_segments_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        s = rng.integers(-5, 5, rng.integers(0, 13)) + rng.random()
        s = (s + rng.random(len(s)) * 1e-3).tolist()
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(s))] == brute_segments(s)


def test_maximal_segments_take_linear_time():
    alone = np.where(np.arange(100_000) % 4 == 0, 1.0, -0.5)
    started = time.process_time()
    assert len(toxicity.maximal_segments(alone)) == 25_000 and time.process_time() - started < 2


def test_toxicity(spark):
    rng = random.Random(3)
    neutral = [f"calm{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows, labels = [], []
    for i in range(1200):
        text = rng.choices(neutral, k=rng.randint(5, 60))
        if bad := i % 6 == 0:
            text.insert(rng.randrange(len(text)), "nastyword" if i % 12 else "Vilething")
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    rows += [(5000, None), (5001, ""), (5001, ""), (5002, "nastyword " * 9000), (None, "calm")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("toxic", "fold", "token", "lang", "segments", "h")})
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score(df, lab).collect()
    held = [r for r in out if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and sum(r["held_out"] for r in out) == len(held)
    checked = [(r["predicted"], int(r["doc_id"] % 6 == 0)) for r in held if r["doc_id"] < 1200]
    assert sum(a == b for a, b in checked) / len(checked) > 0.98
    by = {r["doc_id"]: r for r in out}
    assert by[5002]["predicted"] == 1 and by[5000]["predicted"] == by[5001]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in out)
    assert rows[6][1][by[6]["segments"][0]["start"] : by[6]["segments"][0]["end"]].lower() in ("nastyword", "vilething")
    assert toxicity.score(df.limit(0), lab).count() == 0 and {r["score"] for r in toxicity.score(df.limit(5), lab.limit(0)).collect()} == {0.0}


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["taken"] == r["size"] * r["copies"] and r["copies"] <= 2 for r in rows)
    assert {r["source"]: r["source_size"] for r in rows}["b"] == 20_000 + 240 + 6
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 3 else "hot") for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(many).toPandas()
    total = got["size"].sum()
    by = got.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert abs(by.target.sum() - 1.5 * total) < 1e-6 and (abs(by.taken - by.target) <= 7).all() and (by.target <= 2 * by["size"] + 1e-9).all()
    level = 1.5 * total
    weights = dict(zip(sorted(by.index), [5, 2, 1, 5, 2, 1]))
    free, left = set(by.index), level
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by["size"][s]}
        if not over:
            break
        left -= sum(2 * by["size"][s] for s in over)
        free -= over
    assert all(abs(by.target[s] - share.get(s, 2 * by["size"][s])) < 1e-6 for s in by.index)
    assert mixing.mix(docs.limit(0)).count() == 0
