"""Texts onto large dictionaries by indel ratio, exactly, without comparing all with all.

With a least ratio t, texts of n and m letters need a common subsequence of L = t (n + m) / 200 letters. Short texts meet by their subsequences: both lists hold all of
n t / (200 - t) letters and more, so the longest one shared is the longest common subsequence and gives the ratio by itself. Longer texts differ by D = n + m - 2 L insertions and
deletions at most. The key is cut into D + 1 pieces, one of which the text has unchanged, or, where these would be short, into so many that one has a single change; where in the text it may
lie follows from the changes that the pieces before must have had. Where pieces are so common that this makes more pairs (dictionaries whose texts begin alike), texts meet by their rarest
pairs of letters instead: they share at least n (3 t - 200) / (200 - t) - 1 of their pairs of neighbouring letters; ordered by how rare they are, the first few of both hold two common ones.
Both ways find all pairs; what meets is compared letter by letter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievespark.functions import parsers as P
from sievespark.functions import similarity

#: Letters up to which both texts meet by subsequences: one of 11 letters has at most 562 at a ratio of 80.
SHORT = 11
#: Letters of a key's piece from which on it is looked for unchanged; shorter ones are joined by twos and looked for with a change.
PIECE = 4
#: Pairs that pieces may make for each text and key; if they make more, the rarest pairs of letters are counted as well and the way of fewer pairs is taken.
MEETINGS = 1000


def subsequences(s: Column, most: int) -> Column:
    """Distinct texts that deleting up to `most` letters leaves, the text itself among them."""
    shorter = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))
    levels = [F.array(s)]
    for _ in range(most):
        levels.append(F.array_distinct(F.flatten(F.transform(F.filter(levels[-1], lambda x: x != ""), shorter))))
    return F.array_distinct(F.concat(*levels))


def _short(df: DataFrame, ratio: float) -> DataFrame:
    """(s, part) for the texts s of at most SHORT letters: a projection a length, as the deletions depend on it."""
    out = None
    for n in range(1, SHORT + 1):
        most = n - math.ceil(n * ratio / (200 - ratio) - 1e-9)
        part = df.where(F.length("s") == n).select("s", F.explode(subsequences(F.col("s"), most)).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.where("part <> ''")


def _pairs_of_letters(s: Column) -> Column:
    """Each two neighbouring letters, numbered where they repeat: 'aba' with 'ab' twice is ab0, ba0, ab1."""
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    return P.let(grams, lambda all: F.transform(all, lambda g, i: F.concat(g, F.size(F.filter(F.slice(all, F.lit(1), i), lambda x: x == g)).cast("string"))))


def _rarest(grams: DataFrame, frequency: DataFrame, ratio: float) -> DataFrame:
    """(s, part): two of the rarest pairs of letters of each text of (s, grams)."""
    n = F.length("s")
    common = F.ceil(n * (3 * ratio - 200) / (200 - ratio) - 1e-9) - 1
    placed = grams.select("s", F.explode("grams").alias("gram")).join(frequency, "gram")
    first = placed.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("g"))
    first = first.select("s", F.transform(F.slice("g", F.lit(1), (n - 1 - common + 2).cast("int")), lambda x: x["gram"]).alias("g"))
    both = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice(F.col("g"), i + 2, F.size("g")), lambda y: F.concat(x, y))))
    return first.select("s", F.explode(both).alias("part"))


def _changes(n: Column, m: Column, ratio: float) -> tuple[Column, Column]:
    """Letters of a text of n that a key of m lacks, and of the key that the text lacks, at most."""
    common = F.ceil(ratio * (n + m) / 200 - 1e-9).cast("int")
    return n - common, m - common


def _without_one(s: Column) -> Column:
    """Distinct texts that deleting one letter leaves."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s)), lambda j: F.concat(F.substr(s, F.lit(1), j - 1), F.substr(s, j + 1))))


def _pieces(texts: DataFrame, keys: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(text, part) and (key, part): the hashes of key pieces, and of the stretches of a text that may be one.

    A change belongs to the piece of its letter, an insertion to that of the next letter. With p pieces and fewer than (e + 1) p changes there is a first piece i up to which they are
    fewer than (e + 1) (i + 1); it has e of them at most, and (e + 1) i to (e + 1) i + e lie before it. They move it by no more places than they are, and by an even number if they are even.
    """
    n, m = F.col("n"), F.col("m")
    texts, keys = texts.select(F.col("s").alias("text"), F.length("s").alias("n")), keys.select(F.col("s").alias("key"), F.length("s").alias("m"))
    more, less = _changes(n, m, ratio)
    plan = texts.select("n").distinct().crossJoin(F.broadcast(keys.select("m").distinct())).where((F.greatest(n, m) > SHORT) & (more >= 0) & (less >= 0))  # a row for two lengths
    plan = plan.select("n", "m", more.alias("more"), less.alias("less")).withColumn("e", F.when((F.col("more") + F.col("less") + 1) * PIECE <= m, 0).otherwise(1))
    plan = plan.withColumn("p", F.floor((F.col("more") + F.col("less")) / (F.col("e") + 1)).cast("int") + 1).checkpoint()
    i, e, p = F.col("i"), F.col("e"), F.col("p")
    start, size = F.floor(i * m / p).cast("int"), F.floor((i + 1) * m / p).cast("int") - F.floor(i * m / p).cast("int")
    hashed = lambda name: F.xxhash64("m", "p", "i", name)

    def cut(df: DataFrame, by: DataFrame, on: str) -> DataFrame:
        return df.join(F.broadcast(by), on).withColumn("i", F.explode(F.sequence(F.lit(0), p - 1))).withColumns({"start": start, "size": size})

    whole = cut(keys, plan.select("m", "e", "p").distinct(), "m").withColumn("x", F.substr("key", F.col("start") + 1, F.col("size")))
    right = whole.withColumn("piece", F.explode(F.concat(F.array("x"), F.when(e == 1, _without_one(F.col("x"))).otherwise(F.array().cast("array<string>")))))
    before, moved, rest = (e + 1) * i, F.col("moved"), F.col("more") + F.col("less") - (e + 1) * i
    reach = F.when(i == 0, 0).otherwise(before + e)
    placed = cut(texts, plan, "n").withColumn("moved", F.explode(F.sequence(F.greatest(-F.col("less"), -reach), F.least(F.col("more"), reach))))
    odd = F.pmod(moved - before, F.lit(2))
    stretch = lambda by: F.when((F.col("start") + moved >= 0) & (F.col("start") + moved + F.col("size") + by <= n), F.substr("text", F.col("start") + moved + 1, F.col("size") + by))
    still = F.when(((odd == 0) | (e == 1)) & (F.abs(n - m - moved) <= rest - odd), F.array(stretch(0)))
    changed = (e == 1) & (odd == 0)
    longer = F.when(changed & (F.col("more") > 0) & (F.abs(n - m - moved - 1) <= rest - 1) & stretch(1).isNotNull(), _without_one(stretch(1)))
    shorter = F.when(changed & (F.col("less") > 0) & (F.abs(n - m - moved + 1) <= rest - 1), F.array(stretch(-1)))
    none = F.array().cast("array<string>")
    left = placed.withColumn("piece", F.explode(F.array_compact(F.concat(*[F.coalesce(x, none) for x in (still, longer, shorter)]))))
    return left.select("text", hashed("piece").alias("part")), right.select("key", hashed("piece").alias("part"))


def _rare(texts: DataFrame, keys: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(text, part) and (key, part) by two of the rarest pairs of letters."""
    left, right = (x.select("s", _pairs_of_letters(F.col("s")).alias("grams")).checkpoint() for x in (texts, keys))
    frequency = left.unionByName(right).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("f")).checkpoint()
    return _rarest(left, frequency, ratio).withColumnRenamed("s", "text"), _rarest(right, frequency, ratio).withColumnRenamed("s", "key")


def _meetings(left: DataFrame, right: DataFrame) -> int:
    """How many pairs the parts make, each counted as often as its texts meet."""
    n, m = (x.groupBy("part").agg(F.count("*").alias(c)) for x, c in ((left, "n"), (right, "m")))
    return int(n.join(m, "part").agg(F.sum(F.col("n").cast("decimal(19,0)") * F.col("m"))).first()[0] or 0)


def candidates(texts: DataFrame, keys: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """(text, part) and (key, part) of longer texts (s) by the way that makes fewer pairs; each similar pair shares a part."""
    parts = _pieces(texts, keys, ratio)
    made = _meetings(*parts)
    if made > MEETINGS * (texts.count() + keys.count()):
        other = _rare(texts, keys, ratio)
        if _meetings(*other) < made:
            return other
    return parts


def similar_pairs(values: DataFrame, dictionary: DataFrame, ratio: float = 80.0) -> DataFrame:
    """(text, key, ratio): all pairs of a text of values (text) and one of the dictionary (key), both distinct, whose indel ratio is at least so much, which must be over 75.

    Null and empty texts are in no pair. Both tables are read several times: checkpoint them before.
    """
    if not 75 < ratio <= 100:
        raise ValueError("the least ratio must lie over 75 and not over 100")
    a, b = (df.select(F.col(c).alias("s")).where("s <> ''") for df, c in ((values, "text"), (dictionary, "key")))
    n, m = F.length("text"), F.length("key")
    left, right = (_short(x, ratio).withColumnRenamed("s", c) for x, c in ((a, "text"), (b, "key")))
    short = left.join(right, "part").groupBy("text", "key").agg(F.max(F.length("part")).alias("common")).select("text", "key", (200.0 * F.col("common") / (n + m)).alias("ratio"))
    # a longer text's partner may be short: all that can have a partner of over SHORT letters take part on the other way
    least = max(2, math.ceil((SHORT + 1) * ratio / (200 - ratio) - 1e-9))
    left, right = candidates(*(x.where(F.length("s") >= least) for x in (a, b)), ratio)
    more, less = _changes(n, m, ratio)
    # a replaced letter is one edit and two changes, so there are no more edits than changes
    near = (F.greatest(n, m) > SHORT) & (more >= 0) & (less >= 0) & (F.levenshtein("text", "key") <= more + less)
    met = left.join(right, "part").where(near).select("text", "key").distinct().checkpoint()  # else the filter by the ratio is pushed below the join
    long = met.select("text", "key", similarity.indel_ratio(F.col("text"), F.col("key")).alias("ratio"))
    return short.unionByName(long).where(F.col("ratio") >= ratio - 1e-9)


def nearest(values: DataFrame, dictionary: DataFrame, threshold: float = 85.0, lead: float = 5.0) -> DataFrame:
    """(text, key, ratio): the key of the dictionary that is nearest to a text, if it is near enough and leads by so much over all others.

    Only keys that lie less than the lead behind a text's best one matter, so near ones are looked for first, and only texts that they leave open meet more.
    """
    found, left = None, values.select("text")
    for least in dict.fromkeys((min(100.0, threshold + lead), threshold, threshold - lead)):
        pairs = similar_pairs(left, dictionary, least).checkpoint()
        order = Window.partitionBy("text").orderBy(F.desc("ratio"), "key")
        two = pairs.withColumn("place", F.row_number().over(order)).where("place <= 2")
        best = two.groupBy("text").agg(F.max(F.when(F.col("place") == 1, F.struct("key", "ratio"))).alias("b"), F.max(F.when(F.col("place") == 2, F.col("ratio"))).alias("second")).checkpoint()
        known = (F.col("b.ratio") >= least + lead) if least > threshold - lead else F.lit(True)
        settled = best.where(known)
        found = settled if found is None else found.unionByName(settled)
        # those whose best is known but not what follows it, and, until the threshold is met, those without any
        left = best.where(~known).select("text") if least <= threshold else left.join(settled.select("text"), "text", "left_anti")
        left = left.checkpoint()
    near = (F.col("b.ratio") >= threshold) & (F.col("second").isNull() | (F.col("b.ratio") - F.col("second") >= lead))
    return found.where(near).select("text", "b.key", "b.ratio")
