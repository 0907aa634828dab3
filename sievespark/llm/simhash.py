"""SimHash near-dedup with a vantage-point tree spread over Spark's tasks.

Fingerprints are partitioned by their Hamming distances to a vantage point, taken within disjoint groups of bit positions. Each
group's distance obeys the triangle inequality by itself and the groups' differences add up, so two fingerprints at `radius` bits or
fewer lie in cells whose distance vectors differ by `radius` in all (the L1 ball). A fingerprint is at home in its own cell and visits the half
of the neighbouring cells that lie after it: each pair that no bound prunes meets in exactly one cell and is compared exactly.
Inside a task, cells that are large split again by distances to vantage points of their own. A cell returns the edges of a
spanning forest, never all its pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import broadcast_if_small, checkpointed, connected_components, dealt_join, met, sliced, spare, table, values

#: Words of a shingle, seed of its hash and bits that linked fingerprints may differ in, as the query's contract has them.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a block, at home or visiting; cells with more are split into blocks that meet two at a time.
BLOCK = 4096
#: Cells are dealt to shards of about so many rows.
SHARD_ROWS = 60_000


def shingle_hashes(text: str | None, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words, repeats included; of all words if they are fewer; nothing without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]), ">u8").astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bit set if it is in over half the hashes; zero without any. Runs of 2^16 hashes are summed at a time."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a signed long for each row; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(shingle_hashes(t, shingle)) for t in values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, fp long")


def masks(k: int) -> np.ndarray:
    """k disjoint groups of the 64 bit positions, dealt in turn."""
    return np.array([sum(1 << b for b in range(g, 64, k)) for g in range(k)], np.uint64)


def groups_for(n: int) -> int:
    """Bit groups for n fingerprints: more as they grow, so that a cell's size does not follow n."""
    return 6 if n < 1 << 26 else 8 if n < 1 << 32 else 12


def neighbours(k: int, radius: int) -> np.ndarray:
    """The offsets of the L1 ball that are positive in their first part that isn't zero."""
    steps = range(-radius, radius + 1)
    found = []
    for picked in range(1, radius + 1):
        for places in itertools.combinations(range(k), picked):
            for values in itertools.product([s for s in steps if s], repeat=picked):
                if sum(map(abs, values)) <= radius and values[0] > 0:
                    offset = np.zeros(k, np.int64)
                    offset[list(places)] = values
                    found.append(offset)
    return np.array(found, np.int64).reshape(-1, k)


def distances(fps: np.ndarray, vantage: int, groups: np.ndarray) -> np.ndarray:
    return np.bitwise_count((fps ^ np.uint64(vantage))[:, None] & groups[None, :]).astype(np.int64)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs within radius, a block of at most 4M comparisons at a time."""
    step = max(1, (1 << 22) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius)
        yield i + at, j


def _pairs(home: np.ndarray, other: np.ndarray, radius: int, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions (in home, in other) within radius; larger sets go down a vantage-point tree."""
    if len(home) * len(other) <= 1 << 18 or depth == 4:
        yield from _close(home, other, radius)
        return
    part = np.array([masks(4)[depth]], np.uint64)  # other bits at every level, so that the bounds are independent
    here, there = distances(home, int(home[0]), part)[:, 0], distances(other, int(home[0]), part)[:, 0]
    for d in np.unique(here):
        rows, cols = np.flatnonzero(here == d), np.flatnonzero(np.abs(there - d) <= radius)
        if len(cols):
            for i, j in _pairs(home[rows], other[cols], radius, depth + 1):
                yield rows[i], cols[j]


def _spanning(home: np.ndarray, visitors: np.ndarray, radius: int, within: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest over the links among home (unless not within) and between home and visitors."""
    every = np.concatenate([home, visitors])
    forest, a, b = Forest(len(every)), [], []
    skip = 0 if within else len(home)
    for i, j in _pairs(home, every[skip:], radius):
        j = j + skip
        keep = i < j  # a pair at home shows up both ways
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            if forest.join(x, y):
                a.append(x)
                b.append(y)
    return every[a], every[b]


def hamming_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for distinct fingerprints (fp long) edges that connect just those that the links within radius bits connect.

    distinct is counted and read three times: checkpoint it before. The vantage point is the fingerprint of the smallest hash.
    """
    spark = distinct.sparkSession
    first = distinct.agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp"), "fp")).alias("v")).first()
    if first["n"] < 2:
        return spark.createDataFrame([], "a long, b long")
    vantage, k = first["v"]["fp"] & ((1 << 64) - 1), groups_for(first["n"])
    groups, ball = masks(k), neighbours(k, radius)
    widths = np.array([int(g).bit_count() + 1 for g in groups], np.int64)
    place = np.concatenate([[1], np.cumprod(widths[:-1])])

    def around(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = vectors[:, None, :] + ball[None, :, :]
        who, where = np.nonzero(((to >= 0) & (to < widths)).all(2))
        return who, to[who, where] @ place

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(distances(fps, vantage, groups) @ place)], ["fp", "cell"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = part.column(0).to_numpy()
                who, to = around(distances(fps.view(np.uint64), vantage, groups))
                cells = np.concatenate([part.column(1).to_numpy(), to])
                home = np.concatenate([np.ones(len(fps), bool), np.zeros(len(who), bool)])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([fps, fps[who]])), pa.array(cells), pa.array(home)], ["fp", "cell", "home"])

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                cells, n = (c.to_numpy() for c in batch.slice(at, 2048).columns)
                who, to = around(cells[:, None] // place % widths)
                none = np.zeros(len(cells) + len(who), np.int64)
                home, visitors = none.copy(), none
                home[: len(cells)], visitors[len(cells) :] = n, n[who]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cells, to])), pa.array(home), pa.array(visitors)], ["cell", "at_home", "visitors"])

    celled = checkpointed(distinct.mapInArrow(homes, "fp long, cell long"))
    load = celled.groupBy("cell").agg(F.count("*").alias("n")).mapInArrow(loads, "cell long, at_home long, visitors long").groupBy("cell").agg(F.sum("at_home").alias("at_home"), F.sum("visitors").alias("visitors"))
    parts = [F.ceil(F.col(c) / BLOCK).cast("int").alias(b) for c, b in (("at_home", "blocks"), ("visitors", "others"))]
    load = checkpointed(load.select("cell", "at_home", "visitors", *parts))
    large = (F.col("at_home") > 0) & (F.greatest("blocks", "others") > 1)
    big = checkpointed(load.where(large).select("cell", "blocks", "others"))
    rows = load.agg(F.sum(F.when(large, F.col("at_home") * (F.col("blocks") + F.col("others")) + F.col("visitors") * F.col("blocks")).otherwise(F.col("at_home") + F.col("visitors")))).first()[0]
    spread = celled.mapInArrow(visits, "fp long, cell long, home boolean")
    zero = F.lit(0)
    if big.limit(1).count():
        # a large cell's fingerprints and its visitors are dealt to blocks; each task (i, j) is the meeting of two of them, or of a block with itself
        spread = spread.join(broadcast_if_small(big), "cell", "left")
        own = F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("blocks")).otherwise(F.col("others"))).cast("int")
        to = F.when(F.col("blocks").isNull(), F.array(zero)).when(F.col("home"), F.sequence(zero, F.col("blocks") + F.col("others") - 1)).otherwise(F.sequence(zero, F.col("blocks") - 1))
        spread = spread.withColumn("own", F.coalesce(F.when(F.col("home"), own).otherwise(F.col("blocks") + own), zero)).withColumn("to", F.explode(to))
        spread = spread.withColumns({"i": F.least("own", "to"), "j": F.greatest("own", "to")})
        alone = F.when(F.col("blocks").isNotNull(), F.xxhash64("cell", "i", "j")).otherwise(F.lit(0).cast("long"))
        spread = spread.select("fp", "cell", (F.col("home") & (F.col("own") == F.col("i"))).alias("home"), "i", "j", alone.alias("alone"))
    else:
        spread = spread.withColumns({"i": zero, "j": zero, "alone": F.lit(0).cast("long")})
    spread = spread.withColumn("shard", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(max(64, int(rows) // SHARD_ROWS))).cast("int"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, cell, i, j, home = pdf["fp"].to_numpy().view(np.uint64), pdf["cell"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["home"].to_numpy()
        order = np.lexsort((fps, ~home, j, i, cell))
        fps, cell, i, j, home = fps[order], cell[order], i[order], j[order], home[order]
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        found = [(np.zeros(0, np.uint64),) * 2]
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(fps)], strict=True):
            n = int(home[a:b].sum())
            if n and b - a > 1:
                found.append(_spanning(fps[a : a + n], fps[a + n : b], radius, bool(i[a] == j[a])))
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]).view(np.int64), "b": np.concatenate([y for _, y in found]).view(np.int64)})

    return spread.groupBy("shard", "alone").applyInPandas(compare, "a long, b long")


def components(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of fingerprints reach.

    A row for each row. Null, empty and wordless texts share the fingerprint zero and are linked like any others; so are repeated
    rows and texts. A null doc_id takes part, but is never the smallest unless the whole component has none. Tables of no rows give none.
    """
    prints = checkpointed(fingerprints(df, shingle))
    least = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    linked = connected_components(hamming_links(least.select("fp"), radius))
    joined = checkpointed(least.select("fp", "least").join(linked.withColumnRenamed("node", "fp"), "fp"))
    smallest = checkpointed(joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")))
    across = dealt_join(joined, smallest, ["component"], F.col("fp")).select("fp", "component_id")
    named = checkpointed(least.join(across, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "n"))
    return dealt_join(prints, named, ["fp"], F.col("doc_id")).select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity. Documents whose fingerprints the vantage-point tree links meet. At a similarity of 0.8 fingerprints of 64 bits
# differ in up to 16, where a tree of Hamming distances prunes nothing; so documents also meet by bands of minima of their shingles. Exact sets decide. Where many
# documents meet, codes whose Hamming distance never exceeds the sets' difference prune by distances to a vantage point.

#: Words of a shingle, the least Jaccard similarity of near-duplicates, bands and minima in a band: a pair of similarity 0.8 misses all bands once in 150,000 times.
NEAR_SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 5
#: Bits of a code, and documents of a bucket's block; a task of a large bucket sees two blocks.
CODE_BITS, MEMBERS = 512, 2048
_ODD = np.random.default_rng(11).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
_MORE = np.random.default_rng(12).integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima of the different shingles; none for a document without words."""
    if not len(hashes):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 4096):
        low = np.minimum(low, (hashes[at : at + 4096, None] * _ODD + _MORE).min(0))  # modulo 2^64
    return [xxhash.xxh64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(low.reshape(BANDS, ROWS))]


def parity_code(hashes: np.ndarray) -> np.ndarray:
    """The parities of CODE_BITS classes of the shingles: an element more or less turns one bit, so codes differ in no more bits than sets in elements."""
    return np.packbits(np.bincount((hashes % np.uint64(CODE_BITS)).astype(np.int64), minlength=CODE_BITS) & 1).view(np.uint64)


def similar_pairs(sets: list[np.ndarray], joined: list[int], first: int, similarity: float, within: bool = True) -> list[tuple[int, int]]:
    """Edges over the pairs (i, j), i < first, of at least that Jaccard similarity that connect what isn't yet; with j >= first unless within.

    sets are different shingles; joined: numbers of the groups that are known already. Sets so similar differ in (1 - s) / (1 + s) of their sizes' sum at most. Members are
    sorted by their codes' distance to a vantage point, the first member's, and each meets those only whose distance differs by no more than that; codes and then sets are compared.
    """
    forest, out, seen = Forest(len(sets)), [], {}
    for i, group in enumerate(joined):
        forest.join(seen.setdefault(group, i), i)
    sizes, codes = np.array([len(x) for x in sets], np.int64), np.stack([parity_code(x) for x in sets])
    apart = np.bitwise_count(codes ^ codes[0]).sum(1).astype(np.int64)
    order = np.argsort(apart, kind="stable")
    ends = np.searchsorted(apart[order], apart[order] + np.floor(sizes[order] * (1 - similarity) / similarity + 1e-9), side="right")
    for at, (i, end) in enumerate(zip(order.tolist(), ends.tolist(), strict=True)):
        others = order[at + 1 : end]
        others = others[(others < first) | (i < first)] if within else others[(others < first) != (i < first)]
        near = others[np.bitwise_count(codes[others] ^ codes[i]).sum(1) <= (sizes[others] + sizes[i]) * (1 - similarity) / (1 + similarity) + 1e-9]
        for j in near.tolist():
            if forest.root(i) != forest.root(j) and min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    forest.join(i, j)
                    out.append((i, j))
    return out


def verified(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are so similar; b may be one document for many. sketches: (node, shingles)."""
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n"))
    hubs = checkpointed(hubs.join(sketches.withColumnsRenamed({"node": "b", "shingles": "sb"}), "b"))
    both = dealt_join(pairs, hubs, ["b"], F.col("a")).join(sketches.withColumnsRenamed({"node": "a", "shingles": "sa"}), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def across(banded: DataFrame, linked: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame | None:
    """Further edges (a, b) among documents of one bucket that linked (node, component) leaves apart; None if there are no such buckets.

    Buckets of the same documents are compared once. A large bucket's documents are dealt to blocks, and each task (i, j) compares two of them, or a block within itself.
    """
    kind = banded.schema["node"].dataType.simpleString()
    held = banded.join(linked, "node", "left").select("band", "key", "node", F.coalesce("component", "node").alias("component"))
    own = F.xxhash64("node").cast("decimal(38,0)")
    buckets = held.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum(own).alias("sum"), F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("least"))
    once = buckets.where("low <> high").groupBy("n", "sum", "least").agg(F.min(F.struct("band", "key")).alias("x"))
    once = checkpointed(once.select("x.band", "x.key", "n", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks")))
    rows = once.agg(F.sum(F.col("n") * F.col("blocks"))).first()[0]
    if not rows:
        return None
    members = met(held, once, ["band", "key"], F.col("node")).withColumn("bucket", F.xxhash64("band", "key"))
    members = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"i": F.least("own", "to"), "j": F.greatest("own", "to"), "alone": F.col("blocks") > 1})
    shard = F.when(F.col("alone"), F.xxhash64("bucket", "i", "j")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(max(12, rows // 2000))))
    listed = checkpointed(members.select("node", F.xxhash64("component").alias("component"), "bucket", "i", "j", "alone", (F.col("own") == F.col("i")).alias("home"), shard.alias("shard")))
    counted = checkpointed(listed.groupBy("node").agg(F.count("*").alias("n")).join(sketches, "node"))
    placed = dealt_join(listed, counted, ["node"], F.col("shard"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bucket", "i", "j", "home"], ascending=[True, True, True, False], kind="stable").reset_index(drop=True)
        bucket, first, second = pdf["bucket"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy()
        new = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])])).tolist()
        left, right = [], []
        for a, b in zip(new, [*new[1:], len(pdf)], strict=True):
            sets = [np.sort(np.asarray(x, np.int64)).view(np.uint64) for x in pdf["shingles"].iloc[a:b]]
            for i, j in similar_pairs(sets, pdf["component"].iloc[a:b].tolist(), int(pdf["home"].iloc[a:b].sum()), similarity, bool(first[a] == second[a])):
                left.append(a + i)
                right.append(a + j)
        x, y = pdf.iloc[left], pdf.iloc[right]
        return pd.DataFrame({"d1": x["doc_id"].array, "t1": x["text_hash"].array, "d2": y["doc_id"].array, "t2": y["text_hash"].array})

    doc = banded.schema["node"].dataType["doc_id"].dataType.simpleString()
    flat = placed.select("shard", "alone", "bucket", "i", "j", "home", "component", "node.doc_id", "node.text_hash", "shingles")
    found = flat.groupBy("alone", "shard").applyInPandas(compare, f"d1 {doc}, t1 long, d2 {doc}, t2 long")
    node = lambda d, t: F.struct(F.col(d).alias("doc_id"), F.col(t).alias("text_hash")).cast(kind)
    return checkpointed(found.select(node("d1", "t1").alias("a"), node("d2", "t2").alias("b")))


def linked_prints(chosen: DataFrame) -> DataFrame:
    """(node, band, key) of (node, fp): one more band, whose buckets are the components of linked fingerprints. A null fp is in none."""
    prints = checkpointed(chosen.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n")))
    linked = connected_components(hamming_links(prints.select("fp")))
    named = checkpointed(prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("key"), "n"))
    return dealt_join(chosen.where("fp is not null").select("node", "fp"), named, ["fp"], F.col("node")).select("node", F.lit(BANDS).alias("band"), "key")


def near_duplicates(df: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, group_doc_id, group_text_hash, first): the group of each document and whether the row's document stands for it.

    Documents are told apart by (doc_id, hash of the text). Texts whose lower-cased words are equal, and texts whose sets of shingles have at least
    that Jaccard similarity, are linked; groups are connected components and the smallest (doc_id, hash) stands for each. Null, empty and
    wordless texts are one group. Texts of any length count whole. A null doc_id comes first. Documents meet where the tree links their fingerprints, as in components(), and where their
    minima of a band agree; each is compared with the smallest one there, and then with all those of the bucket that aren't in its group by then.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            same, found, prints = [], [], []
            for text in values(batch.column(2)):
                words = (text or "").encode().lower().split()
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                found.append(bands(np.unique(shingle_hashes(text, shingle))))
                fp = simhash(shingle_hashes(text, SHINGLE))
                prints.append((fp - (1 << 64) if fp >> 63 else fp) if words else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(prints, pa.int64())], ["doc_id", "text_hash", "same", "bands", "fp"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.list_(pa.int64()))], ["node", "shingles"])

    kind = dict(df.dtypes)["doc_id"]
    rows = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    keyed = checkpointed(rows.mapInArrow(keys, f"doc_id {kind}, text_hash long, same binary, bands array<long>, fp long"))
    node = F.struct("doc_id", "text_hash")
    # one document for all with the same words; the others follow it
    chosen = checkpointed(keyed.groupBy("same").agg(F.min(node).alias("node"), F.first("bands").alias("bands"), F.first("fp").alias("fp"), F.count("*").alias("n")))
    banded = chosen.select("node", F.posexplode("bands").alias("band", "key")).unionByName(linked_prints(chosen))
    shared = checkpointed(banded.groupBy("band", "key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1"))
    banded = checkpointed(dealt_join(banded, shared, ["band", "key"], F.col("node")))
    pairs = checkpointed(banded.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    banded = banded.drop("least")
    wanted = checkpointed(banded.select("node").distinct().select("node", F.col("node.doc_id").alias("__d"), F.col("node.text_hash").alias("__t")))
    texts = rows.join(broadcast_if_small(wanted), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__t")))
    sketched = texts.select("node", "text").mapInArrow(sets, f"node struct<doc_id: {kind}, text_hash: bigint>, shingles array<long>")
    sketched = checkpointed(sketched.groupBy("node").agg(F.first("shingles").alias("shingles")))
    edges = checkpointed(verified(pairs, sketched, similarity))
    linked = checkpointed(connected_components(edges))
    more = across(banded, linked, sketched, similarity)
    if more is not None and more.limit(1).count():
        linked = checkpointed(connected_components(edges.unionByName(more)))
    named = checkpointed(chosen.select("same", "node", "n").join(linked, "node", "left").select("same", F.coalesce("component", "node").alias("group"), "n"))
    out = dealt_join(keyed.select("doc_id", "text_hash", "same"), named, ["same"], F.col("text_hash"))
    return out.select("doc_id", "text_hash", F.col("group.doc_id").alias("group_doc_id"), F.col("group.text_hash").alias("group_text_hash"), (F.struct("doc_id", "text_hash") == F.col("group")).alias("first"))


def one_of_each(df: DataFrame, shingle: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents that stand for their group of near-duplicates, with all their columns; of repeated rows with one doc_id and text one stays."""
    d, t, h = spare(df, "d", "t", "h")
    judged = checkpointed(near_duplicates(df, shingle, similarity).select(F.col("doc_id").alias(d), F.col("text_hash").alias(t), "first"))
    seen = checkpointed(judged.groupBy(d, t).agg(F.max("first").alias("first"), F.count("*").alias("n")))
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(h) == F.col(t))
    gone = broadcast_if_small(checkpointed(seen.where("not first").select(d, t)))
    stay = df.withColumn(h, F.xxhash64("text")).join(gone, same, "left_anti")
    often = checkpointed(seen.where("first and n > 1").select(d, t))
    if not often.limit(1).count():
        return stay.drop(h)
    often = broadcast_if_small(often)
    return stay.join(often, same, "left_anti").unionByName(stay.join(often, same, "left_semi").dropDuplicates(["doc_id", h])).drop(h)
