"""Importance resampling of documents towards a target distribution.

Features (runs of words) fall into hashed buckets. A pass over the documents leaves their sparse document-by-bucket count matrix behind as
CSR blocks in the shared folder: a row of the table is a block of documents with row pointers, buckets and counts. Column sums of the blocks and of the
target's give both distributions, hence a gain for each bucket; the blocks' sparse product with the gains gives each document's weight without another look at a text. The
highest weights with Gumbel noise are a sample without replacement. Their threshold comes from a histogram, and only what lies above it is ranked, by ranges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievespark.llm.common import checkpointed, sliced, table, values

#: Longest run of words, buckets, words that a document needs to be drawn, per cent drawn, and the seed of the noise.
RUN, BUCKETS, LEAST, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Documents of a CSR block, and of a range that a task sorts.
ROWS, RANGE = 512, 100_000
#: Lower-case ASCII letters and digits and all of what isn't ASCII stay; the rest parts words.
_PARTS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_PARTS).split()


class Buckets(dict):
    """word -> bucket; forgets all when it holds 2^17."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[feature] = found = crc32(feature) % self.buckets
        return found


def counted(text: str | None, run: int, buckets: Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, different buckets in order, counts) of a text's runs of 1 to run words."""
    parts = words(text)
    where = [np.fromiter(map(buckets.__getitem__, parts), np.int32, len(parts))]
    for n in range(2, run + 1):
        where.append(np.array([crc32(b" ".join(parts[i : i + n])) % buckets.buckets for i in range(len(parts) - n + 1)], np.int32))
    found, n = np.unique(np.concatenate(where), return_counts=True)
    return len(parts), found, n


def matrix(docs: DataFrame, key: str = "doc_id", run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """CSR blocks (ids, words, indptr, indices, counts) of (key, text): document i of a block has counts[j] features in bucket indices[j] for indptr[i] <= j < indptr[i + 1]."""
    kind = dict(docs.dtypes)[key]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in sliced(batches, ROWS):
            rows = [counted(text, run, known) for text in values(batch.column(1))]
            ends = np.cumsum([0, *(len(r[1]) for r in rows)])
            packed = [np.array([r[0] for r in rows], np.int64), ends.astype(np.int32), *(np.concatenate([r[c] for r in rows]).astype(np.int32) for c in (1, 2))]
            ids = batch.column(0)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, *map(pa.array, packed))], ["ids", "words", "indptr", "indices", "counts"])

    return docs.select(key, "text").mapInArrow(blocks, f"ids array<{kind}>, words array<long>, indptr array<int>, indices array<int>, counts array<int>")


def column_sums(csr: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The features in each bucket. A task sends no more than a row a bucket, the driver gets as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches, 16):
            at, n = (batch.column(c).flatten().to_numpy() for c in (0, 1))
            np.add.at(total, at, n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in csr.select("indices", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket the thousandfold logarithm of how much commoner it is in the target, smoothed by one a bucket, floored."""
    s, t, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + size) / (float(a + 1) * float(t + size)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int = SEED) -> int:
    """Thousandfold Gumbel noise of an id, floored; a null id counts as an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(csr: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) from the blocks' products with the gains."""
    kind = csr.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            ids, length, ends, at, n = (c.flatten() for c in batch.columns)
            ends, n = ends.to_numpy(), n.to_numpy().astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(x)])[ends] for x in (n * gain[at.to_numpy()], n)]
            total, features = (x[1:] - x[:-1] for x in sums)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, length, *map(pa.array, (features, weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return csr.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def ranked(scored: DataFrame, able: Column, want: int) -> DataFrame:
    """scored (doc_id, weight, score, ...) with rank: 1, 2, 3, ... for the `want` able rows of highest score, ties to the smaller doc_id, a null one last; else null.

    Scores are whole thousandths of logarithms, some 10^5 different ones however many rows there are, so their histogram is a small table; only rows at or above the score that
    it ends at are sorted, range by range, and a range's ranks start where the ranges before it end. Rows that no column tells apart are ranked in some order. scored is read
    several times: checkpoint it before.
    """
    none = F.lit(None).cast("long")
    line = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))
    least = line.where(F.col("upto") >= want).agg(F.max("score")).first()[0] if want > 0 else None
    if least is None:
        return scored.withColumn("rank", none)
    above = F.coalesce(able, F.lit(False)) & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("tie")]
    high = checkpointed(scored.where(above).withColumn("tie", F.monotonically_increasing_id()))
    ranges = high.repartitionByRange(max(1, -(-high.count() // RANGE)), *order).sortWithinPartitions(*order)
    ranges = checkpointed(ranges.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    top = ranges.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= want, rank).cast("long"))
    return scored.where(~above).withColumn("rank", none).unionByName(top.select(*scored.columns, "rank"))


def resample(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a row for each row of docs (doc_id, text); rank is null unless the document is drawn.

    target: (text, ...) of what the sample shall resemble. Of the documents with at least `least` words, the `percent` of highest score are drawn. Null, empty and wordless
    texts have no features and weight 0. Very long texts count whole. Repeated rows are documents of their own with one score; ties go to the smaller doc_id,
    a null doc_id last. Other columns don't matter, whatever their names. No documents: no rows; no target: every bucket is as rare there.
    """
    csr = checkpointed(matrix(docs, "doc_id", run, buckets))
    aim = matrix(target.select(F.lit(0).alias("key"), "text"), "key", run, buckets)
    scored = checkpointed(weighted(csr, gains(column_sums(csr, buckets), column_sums(aim, buckets)), seed))
    able = F.col("n_words") >= least
    return ranked(scored, able, scored.where(able).count() * percent // 100).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
