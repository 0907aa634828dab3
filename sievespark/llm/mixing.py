"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a hash of its id in [0, 2^60). A source takes whole copies of all its documents while the target allows
it, and for the rest every document whose hash lies below the source's threshold. The threshold comes from histograms: words summed by
(source, top bits of the hash); the bucket in which the running total crosses the budget is the boundary bucket, and only its
documents are summed again by the next bits, until a bucket is a single hash. Nothing is sorted but bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievespark.llm.common import WORD, broadcast_if_small, checkpointed, spare, table

#: Weights dealt to the sources in code point order, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Share of all words that the mix takes, and how often a document may be repeated.
SHARE, REPEATS = 1.5, 2.0
#: Bits of the hash, and of one level of the histogram.
BITS, STEP = 60, 12


def doc_hash(doc_id: Column) -> Column:
    """60 bits of MD5 of the id as text; a null id hashes as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """(source, source_size) -> with weight and target added.

    Sources share `share` of all words by weight. The targets that would pass `repeats` times the source's size stop there and
    the excess is dealt again. In order of size over weight, the sources that stop are a prefix; its length follows from running sums.
    The table has one row a source, a dimension that is far smaller than the documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = sources.withColumn("weight", F.element_at(w, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", repeats * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = ranked.select(
        "*",
        F.row_number().over(fill).alias("position"),
        F.coalesce(F.sum("limit").over(before), F.lit(0.0)).alias("stopped"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"),
        (share * F.sum("source_size").over(every).cast("double")).alias("budget"),
    )
    level = (F.col("budget") - F.col("stopped")) / F.col("open_weight")
    first = F.min(F.when(level * F.col("weight") <= F.col("limit"), F.struct("position", level.alias("level"))))
    leveled = summed.withColumn("level", first.over(every)["level"])
    return leveled.select("source", "source_size", "weight", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))).alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, copies, below): all documents of a source `copies` times, and once more those with h < below.

    sized: (source, h, size); goals: (source, source_size, target). The running total over the hashes ends as near to the target
    as whole documents allow; of two equally near ends the smaller one counts. Documents that share a hash are taken together.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.select("source", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    sized = sized.where("size > 0")
    histogram = sized.groupBy("source", F.shiftright("h", BITS - STEP).alias("b")).agg(F.sum("size").alias("n"))
    for level in range(1, BITS // STEP + 1):
        running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        line = histogram.withColumn("upto", F.sum("n").over(running))
        budget = state.select(F.col("source").alias("s"), F.col("left").alias("budget"))
        crossed = line.join(budget, F.col("source").eqNullSafe(F.col("s"))).where("upto > budget").groupBy("s").agg(F.min(F.struct("b", "n", "upto")).alias("c"))
        before = F.col("left") - (F.col("c.upto") - F.col("c.n"))
        state = state.select("source", "copies", "left").join(crossed, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "copies", F.coalesce(before, F.col("left")).alias("left"), F.col("c.b").alias("prefix"), F.col("c.n").alias("n"))
        state = checkpointed(state)
        if level * STEP == BITS:
            break
        shift = BITS - level * STEP
        inside = broadcast_if_small(state.where("prefix is not null").select(F.col("source").alias("s"), "prefix"))
        rows = sized.join(inside, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("prefix")), "left_semi")
        histogram = rows.groupBy("source", F.shiftright("h", shift - STEP).alias("b")).agg(F.sum("size").alias("n"))
    # the last bucket is one hash: in if that ends nearer to the target
    take = F.when(F.col("n") - F.col("left") < F.col("left"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    return state.select("source", "copies", F.when(F.col("prefix").isNull(), F.when(F.col("left") > 0, F.lit(1 << BITS)).otherwise(0)).otherwise(take).cast("long").alias("below"))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Adds size, source_size, target, copies and taken (size times copies) to documents (doc_id, text, source, ...).

    Null or empty text: size 0, taken 0. A null source is a source of its own, last in order. Rows with one doc_id are taken alike;
    a null doc_id counts as an id. An empty table gives an empty table. Other columns pass through untouched, whatever their names,
    unless they bear the name of an added column: those are replaced.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in df.columns if c not in added]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = checkpointed(df.select("source", doc_hash(F.col("doc_id")).alias("h"), size.alias("size")))
    goals = checkpointed(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    src, whole, below, h = spare(df, "src", "whole", "below", "h")
    ends = thresholds(sized, goals).select(F.col("source").alias(src), F.col("copies").alias(whole), F.col("below").alias(below))
    plan = goals.join(ends, F.col("source").eqNullSafe(F.col(src))).select(src, "source_size", "target", whole, below)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], size.alias("size"), doc_hash(F.col("doc_id")).alias(h))
    out = rows.join(broadcast_if_small(checkpointed(plan)), F.col("source").eqNullSafe(F.col(src)), "left")
    copies = F.when(F.col("size") > 0, F.col(whole) + (F.col(h) < F.col(below)).cast("long")).otherwise(0).cast("long")
    return out.withColumn("copies", copies).select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
