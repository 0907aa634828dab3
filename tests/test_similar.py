"""Joins onto dictionaries, pairs and components against plain Python."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sievespark.functions import similarity
from sievespark.operators import entity, joins, matching, similar


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def spoilt(rng, s, letters):
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
    return s


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyz"])
def test_similar_pairs(spark, letters):
    rng = random.Random(3)
    keys = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 10, 11, 12, 13, 14, 17, 24, 40]))) for _ in range(70)} | {"aaaa" * 6}
    texts = {spoilt(rng, rng.choice(sorted(keys)), letters) for _ in range(70)} | {"", "zz"}
    values, dictionary = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").checkpoint(), spark.createDataFrame([(k,) for k in keys], "key string").checkpoint()
    got = {(r["text"], r["key"]): round(r["ratio"], 9) for r in similar.similar_pairs(values, dictionary, 80.0).collect()}
    assert got == {(t, k): round(ratio(t, k), 9) for t in texts for k in keys if t and ratio(t, k) >= 80 - 1e-9}
    best = {r["text"]: r["key"] for r in similar.nearest(values, dictionary).collect()}
    for t in texts - {""}:
        ranked = sorted(((ratio(t, k), k) for k in keys), reverse=True)
        sure = ranked[0][0] >= 85 and ranked[0][0] - ranked[1][0] >= 5
        assert best.get(t) == (ranked[0][1] if sure else None)
    assert similar.nearest(values.limit(0), dictionary).count() == 0


def test_similar_pairs_of_codes(spark):
    """Random codes over few letters share most pairs of letters; pieces of them seldom meet."""
    codes = [hashlib.md5(str(i).encode()).hexdigest()[:29] for i in range(600)]
    rows = spark.createDataFrame([(c,) for c in codes], "s string").checkpoint()
    for ratio, most in ((90.0, 700), (85.0, 2000)):
        left, right = similar.candidates(rows, rows, ratio)
        assert 600 <= left.join(right, "part").select("text", "key").distinct().count() < most


def test_similar_pairs_that_begin_alike(spark, monkeypatch):
    """The way by the rarest pairs of letters, for keys whose pieces are common, has the same result."""
    monkeypatch.setattr(similar, "candidates", similar._rare)
    rng = random.Random(9)
    keys = {"merkezmahallesiataturkcaddesi" + "".join(rng.choice("abcdefghijklmnop") for _ in range(12)) for _ in range(60)}
    texts = {spoilt(rng, k, "xyz") for k in keys}
    values, dictionary = spark.createDataFrame([(t,) for t in texts], "text string").checkpoint(), spark.createDataFrame([(k,) for k in keys], "key string").checkpoint()
    got = {(r["text"], r["key"]) for r in similar.similar_pairs(values, dictionary, 90.0).collect()}
    assert got == {(t, k) for t in texts for k in keys if ratio(t, k) >= 90 - 1e-9}


def test_completions(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(200)}
    wild = {"".join("?" if rng.random() < 0.4 else c for c in rng.choice(sorted(words))) for _ in range(150)} | {"??????????", "?"}
    wild = {w for w in wild if "?" in w}
    dictionary = spark.createDataFrame([(w, w.upper()) for w in words], "key string, spelling string")
    got = {r["wild"]: r["spelling"] for r in matching.completions(spark.createDataFrame([(w,) for w in wild], "wild string"), dictionary).collect()}
    fits = {w: [k for k in words if re.fullmatch(w.replace("?", "."), k)] for w in wild}
    assert got == {w: k[0].upper() for w, k in fits.items() if len(k) == 1}


def weighted(a, b):
    """The weighted ratio of two texts, stated over lists of words and all windows."""
    if not a or not b:
        return 0.0
    x, y = sorted(a.split()), sorted(b.split())
    both, left, right = sorted(set(x) & set(y)), sorted(set(x) - set(y)), sorted(set(y) - set(x))
    join = " ".join

    def window(p, q):
        p, q = sorted((p, q), key=len)
        return max((ratio(p, q[max(i, 0) : i + len(p)]) for i in range(1 - len(p), len(q))), default=0.0) if p and q else 0.0

    if max(len(a), len(b)) < 1.5 * min(len(a), len(b)):
        shared = 100.0 if both and not (left and right) else max([ratio(join(both + left), join(both + right))] + [ratio(join(both), join(both + r)) for r in (left, right) if both])
        return max(ratio(a, b), 0.95 * max(ratio(join(x), join(y)), shared))
    scale = 0.9 if max(len(a), len(b)) < 8 * min(len(a), len(b)) else 0.6
    loose = 100.0 if both else max(window(join(x), join(y)), window(join(left), join(right)))
    return max(ratio(a, b), scale * window(a, b), 0.95 * scale * loose)


def test_weighted_ratio(spark):
    rng = random.Random(5)
    texts = ["kargo", "yurtici kargo", "kargo yurtici", "mng", "trendyol express", "express", "a", "ab ab", "x y z", "aras kargo", "kargo aras express", "hepsijet", ""] + ["".join(rng.choice("ab ") for _ in range(9)).strip() for _ in range(6)]
    rows = list(itertools.product(texts, texts))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.weighted_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r["r"] - weighted(r["a"], r["b"])) < 1e-9 for r in got)


def someone(rng, i):
    pick = lambda *v: rng.choice([None, *v])
    mail = pick("ay", "aya", "ayb", "a", "ayab")
    return (i, f"M{i % 37:05d}", rng.choice(["Ali", "Veli"]), rng.choice(["Veli", "Ak"]), pick("1990-01-01", "1991-01-01", "1992-01-01"), pick("1", "2", "3", "4"), mail and mail + rng.choice(["@x.com", "@y.com"]), pick("Fatih", "Of"), "2020-01-01")


PEOPLE = "o long, id string, first string, last string, birth string, phone string, email string, district string, since string"
ROLES = {"birth": "birth", "phone": "phone", "email": "email", "district": "district"}


def evidence(x, y):
    same = lambda c: x[c] is not None and x[c] == y[c]
    strong = sum(same(c) for c in (4, 5, 6))
    p, q = sorted(((r[6] or "").split("@")[0] for r in (x, y)), key=len)
    alike = x[6] is not None and y[6] is not None and not same(6) and p != q and q.startswith(p) and len(q) - len(p) <= 1
    medium = same(7) + alike
    return "yes" if strong >= 2 or (strong and medium) else "uncertain" if strong == 1 or medium >= 2 else "no"


@pytest.mark.parametrize("block", [1000, 4])
def test_pairs_and_links(spark, monkeypatch, block):
    monkeypatch.setattr(entity, "BLOCK", block)
    monkeypatch.setattr(joins, "ROWS", 8)
    rng = random.Random(block)
    people = [someone(rng, i) for i in range(70)]
    df = spark.createDataFrame(people, PEOPLE)
    want = {(x[0], y[0]): d for x in people for y in people if x[0] < y[0] and {x[2], x[3]} == {y[2], y[3]} and (d := evidence(x, y)) != "no"}
    assert {(r["a"], r["b"]): r["decision"] for r in entity.decided_pairs(df, "first", "last", ROLES, "o").collect()} == want
    yes = spark.createDataFrame([p for p, d in want.items() if d == "yes"], "a long, b long")
    links = entity.certain_links(df, "first", "last", ROLES, "o")
    roots = lambda e: {r["node"]: r["root"] for r in entity.components(e).collect()}
    assert roots(links) == roots(yes)
    merged, mapping = entity.merge(df, entity.components(links), "id", "o", own=["since"])
    clusters = {}
    for node, root in roots(yes).items():
        clusters.setdefault(root, []).append(people[node])
    heads = {root: min((p[1], p[0]) for p in c)[0] for root, c in clusters.items()}
    assert {(r["old_id"], r["new_id"]) for r in mapping.collect()} == {(p[1], heads[root]) for root, c in clusters.items() for p in c if p[1] != heads[root]}
    assert merged.count() == 70 - sum(len(c) - 1 for c in clusters.values())


def test_a_frequent_name_in_one_district(spark):
    """20,000 people of one name and one district, but nothing else in common: no pairs, and no work in proportion to their square."""
    n = 20_000
    df = spark.range(n).selectExpr("id as o", "'x' as id", "'Ali' as first", "'Ak' as last", "cast(date_add(date'1920-01-01', cast(id as int)) as string) as birth", "cast(id as string) as phone", "concat(id, '.', id, '@x.com') as email", "'Fatih' as district")
    assert entity.decided_pairs(df, "first", "last", ROLES, "o").count() == 0 and entity.certain_links(df, "first", "last", ROLES, "o").count() == 0


def test_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(joins, "ROWS", 20)
    star = spark.range(1, 400).selectExpr("id as a", "0L as b")
    chain = spark.range(10_000, 10_060).selectExpr("id as a", "id + 1 as b")
    roots = entity.components(star.unionByName(chain)).groupBy("root").count().collect()
    assert {r["root"]: r["count"] for r in roots} == {0: 400, 10_000: 61}
    assert entity.components(star.limit(0)).count() == 0


def test_rows_of_one_file_are_spread(spark):
    """A task's rows don't grow with the table, however few parts a file is read in."""
    one = spark.range(0, 3 * joins.PART_ROWS, 1, 1).toDF("row_idx")
    parts = joins.spread(one, "row_idx").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 3 * joins.PART_ROWS and max(r["count"] for r in parts) < 1.1 * joins.PART_ROWS


@pytest.mark.parametrize("sent", [0, 10_000])
def test_a_frequent_value_meets_its_match_everywhere(spark, monkeypatch, sent):
    """The rows of a frequent value stay in several tasks, and nulls and rare values keep their rows, whether the matches are sent or dealt."""
    monkeypatch.setattr(matching, "SENT", sent)
    value = F.when(F.col("id") % 10 == 0, None).when(F.col("id") % 10 == 1, F.concat(F.lit("v"), "id")).otherwise("often")
    rows = spark.range(0, 20_000, 1, 8).select("id", value.alias("raw"))
    out = matching.matched(rows, "raw", F.upper).withColumn("part", F.spark_partition_id()).checkpoint()
    assert out.count() == 20_000 and out.where("not (raw_match <=> upper(raw))").count() == 0
    assert out.where("raw = 'often'").select("part").distinct().count() > 1
