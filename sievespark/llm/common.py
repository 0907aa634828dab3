"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs of anything but ASCII white space, as the contracts of the word-based operators define words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one key that a task of a join takes, and the most keys that can have more (fewer than this hold over one part in so many of all rows).
DEAL, HOT_KEYS = 1000, 20_000
#: Edges of a node that a task of a round of connected_components takes; Spark can split a join's partitions, but not a window's.
HUB = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared checkpoint folder, which the session names in ``spark.checkpoint.dir``.

    A local session that names none (a test) gets one of its own; on a cluster that raises an error, as a folder of one machine would lose the files of the others.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def values(column: pa.Array, at_once: int = 256) -> Iterator:
    """The values of an Arrow column as Python objects, few of them at a time: texts may be long."""
    for at in range(0, len(column), at_once):
        yield from column.slice(at, at_once).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows, so that what a task makes of long texts is handed on in small pieces."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, hinted for a broadcast if it has at most so many (narrow) rows; else left to a shuffled join. df is counted: checkpoint it before."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt_join(many: DataFrame, one: DataFrame, keys: list[str], salt: Column, n: str = "n") -> DataFrame:
    """Inner join of many with one, a row for each key, in which a key with many rows is dealt to several tasks.

    one[n]: rows of many that bear the key (n itself isn't returned); salt: a column of many by whose hash rows are dealt. one is read twice: checkpoint it
    before. Only keys with over 1/HOT_KEYS of all rows are dealt, so fewer than HOT_KEYS are broadcast, however large the tables are.
    """
    most = one.agg(F.max(n).alias("most"), F.sum(n).alias("total")).first()
    share = max(DEAL, (most["total"] or 0) // HOT_KEYS)
    if (most["most"] or 0) <= share:
        return many.join(one.drop(n), keys)
    deal, part = spare(many.join(one, keys), "deal", "part")
    hot = one.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias(deal))
    left = many.join(F.broadcast(hot), keys, "left").withColumn(part, F.pmod(F.xxhash64(salt), F.coalesce(deal, F.lit(1))).cast("int")).drop(deal)
    right = one.withColumn(part, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(n) / share), F.lit(1)).cast("int") - 1))).drop(n)
    return left.join(right, [*keys, part]).drop(part)


def smallest(df: DataFrame, h: Column, n: int) -> DataFrame:
    """The n rows of the smallest hash h (64 bits, as xxhash64 gives it), all if they are fewer: a bounded sample for fitting.

    One count gives a threshold under which little more than n hashes lie; only those rows are gathered and sorted, however many partitions there are. The threshold
    grows in the unlikely case that too few lie under it. df is counted and then read once or more.
    """
    total = df.count()
    if total <= n:
        return df
    wide = n + 8 * int(n**0.5) + 64
    while wide < total:
        few = checkpointed(df.where(h < F.lit(min((1 << 63) - 1, wide * (1 << 64) // total - (1 << 63)))))
        if few.count() >= n:
            return few.orderBy(h).limit(n)
        wide *= 2
    return df.orderBy(h).limit(n)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def met(many: DataFrame, one: DataFrame, keys: list[str], salt: Column, rows: int = 100_000) -> DataFrame:
    """Inner join of many with one (a row for each key, with n as dealt_join has it): one is broadcast if it has at most so many rows. Checkpoint one before."""
    if one.limit(rows + 1).count() <= rows:
        return many.join(F.broadcast(one.drop("n")), keys)
    return dealt_join(many, one, keys, salt)


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (u, v) with m of least (u, m, n), which has a row for each u; n: edges of u. Nodes with over HUB edges are dealt as by dealt_join, but with a union and a window in place of the join.

    Spark takes a join's size to be the product of both sides' sizes, and a checkpoint hands that estimate on: joins of a loop's own tables give the number several times
    the digits with each round, until it fills the driver's memory. A union's size is a sum. least is read twice: checkpoint it before.
    """
    most = least.agg(F.max("n").alias("most"), F.sum("n").alias("total")).first()
    share = max(HUB, (most["total"] or 0) // HOT_KEYS)
    deal, kind = F.greatest(F.ceil(F.col("n") / share), F.lit(1)).cast("int"), edges.schema["v"].dataType
    left, right = edges.withColumn("part", F.lit(0)), least.withColumn("part", F.lit(0))
    if (most["most"] or 0) > share:
        # fewer than HOT_KEYS nodes have so many edges, so the limit leaves none out; it bounds the estimate
        hot = least.where(F.col("n") > share).select("u", deal.alias("deal")).limit(HOT_KEYS)
        left = edges.join(F.broadcast(hot), "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("deal", F.lit(1))).cast("int"))
        right = least.withColumn("part", F.explode(F.sequence(F.lit(0), deal - 1)))
    none = F.lit(None).cast(kind)
    both = left.select("u", "part", "v", none.alias("m")).unionByName(right.select("u", "part", none.alias("v"), "m"))
    return both.withColumn("m", F.max("m").over(Window.partitionBy("u", "part"))).where("v is not null").select("u", "v", "m")


def connected_components(edges: DataFrame, checkpoint=checkpointed) -> DataFrame:
    """Components of an undirected graph as (node, component), component being the smallest node reachable.

    edges has two columns (a, b) of one orderable type; self loops and repeats are harmless. Alternating large-star and
    small-star steps run as grouped minima that are handed to the edges until the edge set no longer changes. Hubs cost no more than other nodes:
    the minima are combined before the shuffle and a hub's edges are dealt to several tasks.
    """
    current = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def sign(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = sign(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n")))
        large = checkpoint(_with_least(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = _with_least(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        current = checkpoint(small)
        now = sign(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
