"""Line dedup by overlapping three-line windows.

A document is cut at line feeds, and a line of more than LONG words also after punctuation, so that a passage within a long line has lines of its
own. Every run of three consecutive lines is hashed (128 bits); a window that occurs again anywhere in the corpus is repeated, and all its
occurrences but the first, by (doc_id, text hash, line number), cover their lines. Covered positions of overlapping windows merge into one set of
lines, which go; what is left is joined as it stood.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import checkpointed, dealt_join, spare, table, values

#: Lines of a window.
WINDOW = 3
#: Words of a line that is cut further, and the least words of a window with a part of such a line: a few short clauses repeat by chance.
LONG, LEAST = 24, 12
#: A part of a long line: up to and with the space after punctuation, or the rest.
PART = r"(?s)(.*?[.!?,;:] |.+)"
_PART = re.compile(PART)
#: Windows that a task hands on at a time.
HANDED = 1 << 15


def _words(text: str) -> int:
    return len(text.encode().split())


def cut(text: str) -> tuple[list[str], list[int], list[bool]]:
    """(parts, lines, whole): the parts of all lines in order, the number of each one's line, and whether it is the whole line."""
    parts, lines, whole = [], [], []
    for n, line in enumerate(text.split("\n")):
        long = len(line) > 2 * LONG and _words(line) > LONG
        some = _PART.findall(line) if long else [line]
        parts += some
        lines += [n] * len(some)
        whole += [not long] * len(some)
    return parts, lines, whole


def window_hashes(text: str, window: int = WINDOW) -> tuple[list[int], list[bytes]]:
    """The places of the windows that count, and their 128-bit hashes."""
    parts, _, whole = cut(text)
    bare = [p.strip(" ").encode() for p in parts]
    sizes, at, hashes = [len(p.split()) for p in bare], [], []
    for i in range(len(bare) - window + 1):
        if sum(sizes[i : i + window]) >= LEAST or all(whole[i : i + window]):
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(b"\n".join(bare[i : i + window])))
    return at, hashes


def repeated_windows(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, positions): the first lines of windows that occurred before, for each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes = [], [], []
            for row, text in enumerate(values(batch.column(2))):
                at, found = window_hashes(text, window)
                rows += [row] * len(at)
                places += at
                hashes += found
                if len(rows) >= HANDED or row == batch.num_rows - 1:
                    h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    own = [batch.column(i).take(pa.array(rows, pa.int64())) for i in range(2)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc_id", "text_hash", "pos", "h1", "h2"])
                    rows, places, hashes = [], [], []

    texts = df.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    each = texts.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, text_hash long, pos int, h1 long, h2 long")
    # which hashes stand in several places takes half of each only; whole ones are compared among the few windows that are left
    place = F.xxhash64("doc_id", "text_hash", "pos")
    several = each.groupBy("h1").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count("*").alias("n")).where("least <> most")
    some = checkpointed(dealt_join(each, checkpointed(several.select("h1", "n")), ["h1"], F.col("text_hash")))
    at = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("d"), F.col("text_hash").alias("t"), F.col("pos").alias("p"))
    firsts = checkpointed(some.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")))
    again = dealt_join(some, firsts, ["h1", "h2"], F.col("text_hash")).where(at != F.col("first"))
    return again.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("positions"))


def without(text: str, positions: np.ndarray, window: int) -> tuple[str, int]:
    """The text without the lines that windows at these places cover, and how many those are."""
    parts, lines, _ = cut(text)
    gone = np.zeros(len(parts), bool)
    for k in range(window):
        gone[np.asarray(positions) + k] = True
    out, last = [], None
    for i in np.flatnonzero(~gone).tolist():
        out += ["\n"] if last is not None and lines[i] != last else []
        out.append(parts[i])
        last = lines[i]
    return "".join(out), int(gone.sum())


def dedup_lines(df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with repeated windows cut from their text; adds lines_removed (long), keeps every other column.

    Null texts stay null, texts with fewer lines than a window (the empty one too) stay as they are: 0 removed. A text whose lines
    are all covered becomes empty. A part of a long line counts as a line of its own in lines_removed. Texts of any length are taken whole, in one row each.
    Copies of a text with one doc_id are one document: each row gets the same result. The first
    document by doc_id keeps a passage; a null doc_id comes first. Columns named lines_removed are replaced.
    """
    kept = [c for c in df.columns if c != "lines_removed"]
    d, t, p, c = spare(df, "d", "t", "p", "c")

    @F.pandas_udf("text string, n long")
    def rest(text: pd.Series, positions: pd.Series) -> pd.DataFrame:
        found = [(None, 0) if x is None else without(x, at, window) for x, at in zip(text, positions, strict=True)]
        return pd.DataFrame(found, columns=["text", "n"])

    found = repeated_windows(df, window).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), F.col("positions").alias(p))
    joined = df.join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")
    joined = joined.withColumn(c, rest(F.when(F.col(p).isNotNull(), F.col("text")), p))  # other texts don't leave the JVM
    cols = [F.when(F.col(p).isNull(), F.col("text")).otherwise(F.col(f"{c}.text")).alias("text") if name == "text" else F.col(f"`{name}`") for name in kept]
    return joined.select(*cols, F.when(F.col(p).isNull(), 0).otherwise(F.col(f"{c}.n")).cast("long").alias("lines_removed"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
