"""Joins that no single key can slow down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes; and the most keys that are dealt: those with over one part in so many of all rows.
ROWS, KEYS = 1000, 20_000


#: Rows of a partition whose keys a task sums up before the shuffle.
PART_ROWS = 50_000


def spread(df: DataFrame, by: str) -> DataFrame:
    """df in partitions of some PART_ROWS rows, by the hash of a column with many values. A file that is read is cut by its bytes and the cores, so a task's rows would grow with the table. df is counted before."""
    return df.repartition(1 + df.count() // PART_ROWS, by)


def dealt(many: DataFrame, one: DataFrame, keys: list[str], salt: Column, n: str = "n") -> DataFrame:
    """Inner join of many with one (a row for each key, no null keys), where the rows of a common key go to several tasks, each with a copy of the key's row.

    one[n] says how many rows of many bear the key, and isn't returned. Keys with over 1/KEYS of all rows are dealt, so fewer than KEYS of them are broadcast, whatever the size of the
    tables. one is read several times: checkpoint it before.
    """
    size = one.agg(F.sum(n).alias("all"), F.max(n).alias("most")).first()
    share = max(ROWS, (size["all"] or 0) // KEYS)
    if (size["most"] or 0) <= share:
        return many.join(one.drop(n), keys)
    pieces = F.ceil(F.col(n) / share).cast("int")
    common = F.broadcast(one.where(F.col(n) > share).select(*keys, pieces.alias("__pieces")))
    left = many.join(common, keys, "left").withColumn("__piece", F.pmod(F.xxhash64(salt), F.coalesce("__pieces", F.lit(1))).cast("int")).drop("__pieces")
    right = one.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1))).drop(n)
    return left.join(right, [*keys, "__piece"]).drop("__piece")
