"""Cleaning and watching a stream: the parsers are plain expressions, so a stream is cleaned like a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(rows: DataFrame, time: str, blanks: dict[str, Column], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, rows, blank_<name>...): rows and the share of blank cells in each window of event time; works on streams and tables."""
    marked = rows.withWatermark(time, late) if rows.isStreaming else rows
    shares = [F.avg(blank.cast("double")).alias(f"blank_{name}") for name, blank in blanks.items()]
    return marked.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("rows"), *shares).select(F.col("w.start").alias("start"), "rows", *[f"blank_{n}" for n in blanks])


def once(rows: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """A stream without the repeats of a key that come within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
