"""Approximate nearest neighbours with randomly rotated one-bit codes.

The index holds, for every vector, the signs of its rotated residual to a centre as packed bits, the residual's length and a
correction, the code's inner product with the residual's direction. A query's distance to a vector is estimated from bits and scalars with an error bound that
holds with high probability; only vectors whose lower bound beats the k-th best upper bound are compared exactly. All vectors are
indexed and met by all queries, block by block; a block returns its best k for each query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievespark.llm.common import checkpointed, smallest, table

#: Vectors that fit the centre (those of smallest hash of the id), the rotation's seed, and the width of the error bound.
SAMPLE, SEED, WIDTH = 20_000, 7, 1.9
#: Vectors and queries that meet in one task.
BLOCK, QUERIES = 4096, 8192


def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, no null or non-finite component, not zero, and the most common length."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == dims["d"]) if dims else rows


def index(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, v, code, length, correction), centre) for (vec_id, v array<double>); v comes back as packed doubles."""
    sample = smallest(rows, F.xxhash64("vec_id"), SAMPLE).select("v").toPandas()["v"]
    dim = len(sample.iloc[0]) if len(sample) else 1
    centre = np.mean(np.stack(sample), 0) if len(sample) else np.zeros(1)
    turn = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            rest = v - centre
            length = np.sqrt((rest**2).sum(1))
            turned = rest @ turn
            correction = np.abs(turned).sum(1) / np.sqrt(dim) / np.where(length > 0, length, 1)
            bits = np.packbits(turned >= 0, axis=1)
            pack = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (v, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pack[0], pack[1], pa.array(length), pa.array(correction)], ["vec_id", "v", "code", "length", "correction"])

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, v binary, code binary, length double, correction double"), centre


def estimates(code: np.ndarray, length: np.ndarray, correction: np.ndarray, queries: np.ndarray, turn: np.ndarray, centre_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, bounds of their errors), queries by vectors. queries are residuals to the centre, centre_gap their lengths."""
    dim = queries.shape[1]
    signs = np.unpackbits(code, axis=1, count=dim).astype(np.float32) * 2 - 1
    inner = (queries @ turn).astype(np.float32) @ signs.T / np.sqrt(dim)
    a = np.maximum(correction, 1e-9)
    both = centre_gap[:, None] * length[None, :]
    bound = WIDTH * np.sqrt(np.maximum(0.0, 1 - a**2) / a**2 / max(1, dim - 1))
    return length[None, :] ** 2 + centre_gap[:, None] ** 2 - 2 * length[None, :] * inner / a, 2 * both * bound


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id that `every` divides, the k nearest other vectors by Euclidean distance.

    vectors: (vec_id, embedding); other columns don't matter. Ties go to the smaller vec_id. Null, zero and non-finite vectors, those with a null
    component, with a null id or with another length than most take no part. Rows that repeat an id are candidates of their own, but never of a query with that id.
    Fewer than k candidates: all of them. No vectors: no rows.
    """
    coded, centre = index(usable(vectors))
    coded, dim = checkpointed(coded), len(centre)
    n = coded.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-(n // every + 1) // QUERIES))
    turn = rotation(dim)
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    rows = coded.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    asked = coded.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), group.alias("group")).dropDuplicates(["query_id", "q"])
    asked = asked.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(some: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        v = np.frombuffer(b"".join(some["v"]), np.float64).reshape(-1, dim)
        code = np.frombuffer(b"".join(some["code"]), np.uint8).reshape(len(some), -1)
        ids, length, correction = some["vec_id"].to_numpy(), some["length"].to_numpy(), some["correction"].to_numpy()
        found = []
        for at in range(0, len(queries), 512):
            part = queries.iloc[at : at + 512]
            q = np.frombuffer(b"".join(part["q"]), np.float64).reshape(-1, dim)
            rest = q - centre
            guess, error = estimates(code, length, correction, rest, turn, np.sqrt((rest**2).sum(1)))
            for name, one, mid, off in zip(part["query_id"].to_numpy(), q, guess, error, strict=True):
                other = ids != name
                upper = np.where(other, mid + off, np.inf)
                if not other.any():
                    continue
                limit = np.partition(upper, min(k, int(other.sum())) - 1)[min(k, int(other.sum())) - 1]
                near = np.flatnonzero(other & (mid - off <= limit))
                exact = np.sqrt(((v[near] - one) ** 2).sum(1))
                best = np.lexsort((ids[near], exact))[:k]
                found.append(pd.DataFrame({"query_id": name, "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})

    part = rows.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInPandas(search, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id", F.pmod("vec_id", F.lit(64))).orderBy("score", "vec_id")
    last = Window.partitionBy("query_id").orderBy("score", "vec_id")
    fewer = part.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    return fewer.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
