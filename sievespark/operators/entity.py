"""Duplicate entities: blocking, evidence on pairs, components, survivors, and the rewrite of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievespark.functions import text as T
from sievespark.operators.joins import dealt, spread

#: Rows that share a sign and meet all others in one task; more are dealt to blocks that meet two at a time.
BLOCK = 1000


def block_key(first: Column, last: Column) -> Column:
    """The unordered pair of both names' keys; null if either is missing."""
    return F.when(first.isNotNull() & last.isNotNull(), F.array_sort(F.array_distinct(F.array(T.key(first), T.key(last)))))


def pair_evidence(a: str, b: str, columns: dict[str, str]) -> Column:
    """struct(strong, medium) counts for rows aliased a and b. columns names birth, phone, email and district.

    Strong: equal birth date, phone or e-mail. Medium: equal district; e-mails whose local parts differ by one letter at the end.
    """
    c = lambda side, name: F.col(f"{side}.{columns[name]}")
    same = lambda name: F.coalesce(c(a, name) == c(b, name), F.lit(False))
    x, y = F.substring_index(c(a, "email"), "@", 1), F.substring_index(c(b, "email"), "@", 1)
    alike = F.coalesce((x.startswith(y) | y.startswith(x)) & (x != y) & (F.abs(F.length(x) - F.length(y)) <= 1), F.lit(False)) & ~same("email")
    return F.struct(sum(same(n).cast("int") for n in ("birth", "phone", "email")).alias("strong"), (same("district").cast("int") + alike.cast("int")).alias("medium"))


def decision(evidence: Column) -> Column:
    strong, medium = evidence["strong"], evidence["medium"]
    return F.when((strong >= 2) | ((strong >= 1) & (medium >= 1)), "yes").when((strong == 1) | (medium >= 2), "uncertain").otherwise("no")


def _local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def decided_pairs(df: DataFrame, first: str, last: str, columns: dict[str, str], order: str) -> DataFrame:
    """(a, b, decision) of row orders for the pairs that aren't "no".

    A pair needs a strong sign or both medium ones, so its rows share a block and a birth date, phone or e-mail, or a district and the local part that one of them has and the other
    continues by a letter. Those are the keys of equi-joins; a frequent name or a frequent name in one district makes no pairs. Rows of a frequent key are dealt to blocks, and each
    task sees two of them.
    """
    rows = spread(df.withColumn("__block", block_key(F.col(first), F.col(last))).where("__block is not null"), order)
    local, district = _local(F.col(columns["email"])), F.col(columns["district"])
    sign = lambda name, side, v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("sign"), F.lit(side).alias("side"), v.alias("v")))
    full = lambda *v: F.when(sum(x.isNotNull().cast("int") for x in v) == len(v), F.concat_ws("\u0001", *v))
    signs = [sign(n, 0, F.col(columns[n]).cast("string")) for n in ("birth", "phone", "email")]
    longer = F.when(F.length(local) > 0, F.substr(local, F.lit(1), F.length(local) - 1))
    signs += [sign("alike", 1, full(district, local)), sign("alike", 2, full(district, longer))]
    keyed = rows.select(F.explode(F.array_compact(F.array(*signs))).alias("s"), "*").withColumn("__s", F.struct("s.sign", "s.v")).withColumn("__side", F.col("s.side")).drop("s").checkpoint()
    sizes = keyed.groupBy("__block", "__s").agg(F.count("*").alias("n")).where("n > 1").select("__block", "__s", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("__blocks")).checkpoint()
    met = dealt(keyed, sizes, ["__block", "__s"], F.col(order))
    met = met.withColumn("__own", F.pmod(F.xxhash64(order), F.col("__blocks")).cast("int")).withColumn("__to", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    met = met.withColumns({"__i": F.least("__own", "__to"), "__j": F.greatest("__own", "__to")})
    a, b = met.alias("a"), met.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("__block", "__s", "__i", "__j")]
    apart = ((F.col("a.__i") == F.col("a.__j")) | (F.col("a.__own") != F.col("b.__own"))) & ((F.col("a.__side") == 0) | (F.col("a.__side") != F.col("b.__side")))
    on = same[0] & same[1] & same[2] & same[3] & apart & (F.col(f"a.{order}") < F.col(f"b.{order}"))
    pairs = a.join(b, on).select(F.col(f"a.{order}").alias("a"), F.col(f"b.{order}").alias("b"), decision(pair_evidence("a", "b", columns)).alias("decision"))
    return pairs.where("decision <> 'no'").distinct()


def certain_links(df: DataFrame, first: str, last: str, columns: dict[str, str], order: str) -> DataFrame:
    """(a, b): links, in proportion to the rows, that connect just what the pairs decided "yes" connect.

    Rows of a block that agree in two strong signs, or a strong one and the district, are all linked to the first of them. Of rows that agree in a strong sign, those with a local part are
    linked to the first of those that continue it by a letter, and the other way round: each of the ones forms a pair with each of the others.
    """
    rows = spread(df.withColumn("__block", block_key(F.col(first), F.col(last))).where("__block is not null"), order)
    birth, phone, email, district = (F.col(columns[n]).cast("string") for n in ("birth", "phone", "email", "district"))
    together = [(birth, phone), (birth, email), (phone, email), (birth, district), (phone, district), (email, district)]

    def key(kind: int, *v: Column) -> Column:
        there = v[0].isNotNull() if len(v) == 1 else v[0].isNotNull() & v[1].isNotNull() & (v[2].isNotNull() if len(v) > 2 else F.lit(True))
        return F.when(there, F.struct(F.lit(kind).alias("kind"), F.concat_ws("\u0001", *v).alias("v")))

    def to_first(keys: list[Column]) -> DataFrame:
        each = rows.select("__block", F.col(order).alias("a"), F.explode(F.array_compact(F.array(*keys))).alias("k"))
        least = each.groupBy("__block", "k").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").checkpoint()
        return dealt(each, least, ["__block", "k"], F.col("a")).where("a <> b").select("a", "b")

    local = _local(email)
    longer = F.when(F.length(local) > 0, F.substr(local, F.lit(1), F.length(local) - 1))
    sides = []
    for part in (local, longer):
        keys = [key(10 + i, strong, part) for i, strong in enumerate((birth, phone))]
        sides.append(rows.select("__block", F.col(order).alias("a"), F.explode(F.array_compact(F.array(*keys))).alias("k")).checkpoint())
    firsts = [x.groupBy("__block", "k").agg(F.min("a").alias("least"), F.count("*").alias("n")).checkpoint() for x in sides]
    across = [dealt(mine, other.drop("n").join(own.select("__block", "k", "n"), ["__block", "k"]).checkpoint(), ["__block", "k"], F.col("a")) for mine, own, other in ((sides[0], firsts[0], firsts[1]), (sides[1], firsts[1], firsts[0]))]
    links = to_first([key(i, *pair) for i, pair in enumerate(together)]).unionByName(across[0].select("a", F.col("least").alias("b"))).unionByName(across[1].select("a", F.col("least").alias("b")))
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): components of (a, b) by the smallest node. Needs a checkpoint folder.

    Large and small stars in turn: every node hands its greater neighbours, then its smaller ones, to the smallest of its neighbourhood, until only stars are left; that takes a number of
    rounds in proportion to the logarithm of the nodes. A hub's edges are dealt to several tasks.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while (now := links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and now[0]:
        before = now
        around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n")).checkpoint()
        links = dealt(around, low, ["u"], F.col("v")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().checkpoint()
        low = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).checkpoint()
        handed = dealt(links, low, ["u"], F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = handed.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merge(df: DataFrame, clusters: DataFrame, key: str, order: str, own: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, mapping (old_id, new_id)). clusters: (node = order, root).

    The survivor of a cluster has the smallest key, nulls last. Its missing values come from the others in that order, except the columns in own. The members' keys meet the survivors
    in a join; no row holds a cluster.
    """
    member = spread(df, order).join(clusters.select(F.col("node").alias("__n"), "root"), F.col(order) == F.col("__n"), "left").drop("__n")
    alone = member.where("root is null").drop("root")
    place = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col(order).alias("o"))
    values = [c for c in df.columns]
    first = [F.min_by(F.struct(*values), place).alias("s")] + [F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__{c}") for c in values if c not in (key, order, *own)]
    grouped = member.where("root is not null").groupBy("root").agg(*first, F.count("*").alias("__size")).checkpoint()
    survivors = grouped.select(*[F.coalesce(F.col(f"s.{c}"), F.col(f"__{c}")).alias(c) if c not in (key, order, *own) else F.col(f"s.{c}").alias(c) for c in values])
    heads = grouped.select("root", F.col(f"s.{key}").alias("new_id"), F.col("__size").alias("n"))
    ids = member.where(F.col("root").isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("old_id"), "root")
    mapping = dealt(ids, heads, ["root"], F.col("old_id")).where("old_id <> new_id").select("old_id", "new_id").distinct()
    return alone.unionByName(survivors), mapping


def rewrite(df: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    moved = mapping.select(F.col("old_id").alias("__o"), F.col("new_id").alias("__w"))
    return df.join(moved, F.col(column) == F.col("__o"), "left").withColumn(column, F.coalesce("__w", column)).drop("__o", "__w")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order; null keys are one key. A partial aggregate, so hot keys are reduced before the shuffle."""
    return df.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def pairs_within(members: DataFrame, *by: str) -> DataFrame:
    """One row: the pairs of members that agree in the columns, as sums of n (n - 1) / 2; none are listed."""
    sizes = members.groupBy(*by).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("pairs"))


def in_scope(predicted: DataFrame, truth: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both mappings (old_id, new_id) for a sample of survivors (key): the true entries that lead to one of them, and the predicted ones that name one of them or of their copies."""
    wanted = ids.select(F.col("key").alias("__k")).distinct()
    t = truth.join(wanted, F.col("new_id") == F.col("__k"), "left_semi")
    related = wanted.unionByName(t.select(F.col("old_id").alias("__k"))).distinct()
    named = predicted.select("old_id", "new_id", F.explode(F.array("old_id", "new_id")).alias("__k")).join(related, "__k", "left_semi")
    return named.select("old_id", "new_id").distinct(), t


def pair_scores(predicted: DataFrame, truth: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row: true_pairs, predicted_pairs, precision, recall and f1 of two mappings (old_id, new_id), whose clusters hold the survivor too; 0 where nothing can be divided. ids: (key) of the sample to score, all if None."""
    if ids is not None:
        predicted, truth = in_scope(predicted, truth, ids)

    def members(mapping: DataFrame, name: str) -> DataFrame:
        return mapping.select(F.col("new_id").alias(name), F.col("old_id").alias("m")).unionByName(mapping.select(F.col("new_id").alias(name), F.col("new_id").alias("m"))).distinct()

    p, t = members(predicted, "p"), members(truth, "t")
    n = pairs_within(t, "t").withColumnRenamed("pairs", "true_pairs").join(pairs_within(p, "p").withColumnRenamed("pairs", "predicted_pairs")).join(pairs_within(p.join(t, "m"), "p", "t").withColumnRenamed("pairs", "hits"))  # three single rows
    share = lambda a, b: F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)
    hits = F.coalesce("hits", F.lit(0))
    rates = n.select("true_pairs", "predicted_pairs", share(hits, F.col("predicted_pairs")).alias("precision"), share(hits, F.col("true_pairs")).alias("recall"))
    return rates.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
