"""Media columns: payloads in a content-addressed chunk store.

A text's bytes become the samples of an 8-bit mono WAV file. The file is cut where a rolling gear hash over the last 32 bytes has
its top bits zero, so equal passages give equal chunks wherever they stand. Chunks are stored once a digest; a medium is an
ordered list of digests, and reading it joins the list with the store, puts the chunks in order and verifies the whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import broadcast_if_small, checkpointed, table

#: Bytes a payload is a multiple of, and samples a second in the WAV header.
UNIT, RATE = 192, 8000
#: Chunk lengths: least, most, and the bits of the hash that are zero at a cut (2^11 bytes between cuts on average).
LEAST, MOST, CUT_BITS = 256, 8192, 11
#: References to one chunk that one task resolves; a chunk with more is dealt to several.
SHARE = 4096
HEADER = 44


def _gear() -> np.ndarray:
    """One 32-bit number for every byte: the first four bytes of the SHA-256 of the byte."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], np.uint32)


GEAR = _gear()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(length of the UTF-8 text, the text padded with spaces to a positive multiple of UNIT)."""
    raw = (text or "").encode()
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def to_wav(samples: bytes) -> bytes:
    n = len(samples)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + samples


def from_wav(medium: bytes) -> bytes:
    """The samples; ValueError if the header isn't one that to_wav writes."""
    if len(medium) < HEADER or to_wav(medium[HEADER:])[:HEADER] != medium[:HEADER]:
        raise ValueError("not an 8-bit mono WAV file of the length it states")
    return medium[HEADER:]


def cuts(medium: bytes) -> list[int]:
    """The ends of the chunks. The hash of a position sums the gear numbers of the last 32 bytes, each shifted by its age."""
    h = GEAR[np.frombuffer(medium, np.uint8)]
    for age in (1, 2, 4, 8, 16):
        h[age:] += h[:-age] << np.uint32(age)
    out, last = [], 0
    for at in (np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + 1).tolist() + [len(medium)]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or at == len(medium) > last:
            out.append(at)
            last = at
    return out


def chunks(medium: bytes) -> list[bytes]:
    ends = cuts(medium)
    return [medium[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def feature(samples: bytes, n_chunks: int) -> str:
    """chunks, least, greatest and summed sample, and how often the signal crosses the middle."""
    x = np.frombuffer(samples, np.uint8)
    high = x >= 128
    return f"chunks={n_chunks};min={x.min()};max={x.max()};sum={int(x.sum(dtype=np.int64))};crossings={int((high[1:] != high[:-1]).sum())}"


def recipes(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, media_bytes, media_sha256, digests) for each row of documents (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n, payload = payload_of(text)
                medium = to_wav(payload)
                rows.append((n, len(payload), len(medium), hashlib.sha256(medium).hexdigest(), [hashlib.sha256(c).digest() for c in chunks(medium)]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "media_bytes", "media_sha256", "digests"])

    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, payload_bytes long, media_bytes long, media_sha256 string, digests array<binary>")


def packs(df: DataFrame) -> DataFrame:
    """(media_sha256, pack): each distinct medium once, its chunks in order as (digest, compressed chunk); a repeat has its digest alone.

    One column, so that all that reads it can share the shuffle. The only shuffle that moves every medium's bytes: copies fall away in it and all later joins on media_sha256 keep its partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                medium = to_wav(payload_of(text)[1])
                name = hashlib.sha256(medium).hexdigest()
                if name not in found:
                    listed, seen = [], set()
                    for chunk in chunks(medium):
                        digest = hashlib.sha256(chunk).digest()
                        listed.append({"digest": digest, "chunk": None if digest in seen else press.compress(chunk)})
                        seen.add(digest)
                    found[name] = listed
            kind = pa.list_(pa.struct([("digest", pa.binary()), ("chunk", pa.binary())]))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), kind)], ["media_sha256", "pack"])

    one = df.select("text").mapInArrow(run, "media_sha256 string, pack array<struct<digest: binary, chunk: binary>>")
    return one.groupBy("media_sha256").agg(F.first("pack").alias("pack"))


def marked(shared: DataFrame) -> bytes:
    """A bitmap of 2^24 bits, whatever the number of digests, that holds the first three bytes of every digest of shared."""
    place = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long")
    parts = shared.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("b")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()
    found = bytearray(1 << 21)
    for part in parts:
        found[part["b"] * 4096 : part["b"] * 4096 + len(part["bits"])] = part["bits"]
    return bytes(found)


def lent_chunks(df: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, chunk): the chunks of shared (digest) once each. The bitmap keeps nearly all others out of the shuffle."""
    bitmap = marked(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                for chunk in chunks(to_wav(payload_of(text)[1])):
                    digest = hashlib.sha256(chunk).digest()
                    at = int.from_bytes(digest[:3], "big")
                    if bitmap[at >> 3] >> (at & 7) & 1 and digest not in found:
                        found[digest] = press.compress(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "chunk"])

    every = df.select("text").mapInArrow(run, "digest binary, chunk binary").groupBy("digest").agg(F.first("chunk").alias("chunk"))
    return every.join(shared.select("digest"), "digest", "left_semi")


def deduplicated(df: DataFrame, refs: DataFrame) -> DataFrame:
    """(media_sha256, pack, fetched): a chunk that several media hold is stored once for all, and with none of them but its owner.

    refs: (media_sha256, digest), once each. The owner is the medium of the smallest hash. Only shared chunks move; one that many
    media fetch is dealt to several tasks.
    """
    packed = packs(df)
    shared = checkpointed(refs.groupBy("digest").agg(F.min("media_sha256").alias("owner"), F.count("*").alias("n")).where("n > 1"))
    lent = lent_chunks(df, shared)
    hot = broadcast_if_small(checkpointed(shared.where(F.col("n") > SHARE).select("digest", F.ceil(F.col("n") / SHARE).cast("int").alias("deal"))))
    deal = F.coalesce("deal", F.lit(1))
    lent = lent.join(hot, "digest", "left").select("digest", "chunk", F.explode(F.sequence(F.lit(0), deal - 1)).alias("part"))
    wanted = refs.join(shared.select("digest", "owner"), "digest").where("media_sha256 <> owner").join(hot, "digest", "left")
    wanted = wanted.select("media_sha256", "digest", F.pmod(F.xxhash64("media_sha256"), deal).cast("int").alias("part"))
    fetched = wanted.join(lent, ["digest", "part"]).groupBy("media_sha256").agg(F.collect_list(F.struct("digest", "chunk")).alias("fetched"))
    foreign = F.transform("fetched", lambda c: c["digest"])
    blank = F.lit(None).cast("binary")
    own = F.transform("pack", lambda c: F.struct(c["digest"].alias("digest"), F.when(~F.array_contains(foreign, c["digest"]), c["chunk"]).otherwise(blank).alias("chunk")))
    return packed.join(fetched, "media_sha256", "left").select("media_sha256", F.when(F.col("fetched").isNull(), F.col("pack")).otherwise(own).alias("pack"), "fetched")


def read_back(stored: DataFrame) -> DataFrame:
    """Verifies each medium and returns (media_sha256, payload_sha256, tail_crc32, feature). Raises if a medium isn't what was stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                name, pack, fetched = (batch.column(i)[row].as_py() for i in range(3))
                held = {c["digest"]: c["chunk"] for c in [*pack, *(fetched or [])] if c["chunk"] is not None}
                medium = b"".join(unpack.decompress(held[c["digest"]]) for c in pack)
                if hashlib.sha256(medium).hexdigest() != name:
                    raise ValueError(f"medium {name} can't be read back")
                samples = from_wav(medium)
                rows.append((name, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), feature(samples, len(pack))))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["media_sha256", "payload_sha256", "tail_crc32", "feature"])

    return stored.select("media_sha256", "pack", "fetched").mapInArrow(run, "media_sha256 string, payload_sha256 string, tail_crc32 long, feature string")


def media_columns(df: DataFrame) -> DataFrame:
    """Stores each text of documents (doc_id, text) as a medium, reads it back and describes it; a row for each row.

    Null and empty texts are UNIT spaces; a text of any length is stored whole. Equal texts share a medium and have equal values, so
    do repeated rows. Other columns don't matter. An empty table gives no rows.
    """
    listed = checkpointed(recipes(df))
    refs = listed.groupBy("media_sha256").agg(F.first("digests").alias("digests")).select("media_sha256", F.explode(F.array_distinct("digests")).alias("digest"))
    read = checkpointed(read_back(deduplicated(df, refs)))
    return listed.drop("digests").join(read, "media_sha256").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))
