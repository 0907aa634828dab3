"""Harmonic packing of token sequences.

A piece of n tokens belongs to the class of the largest j with j n <= capacity, and a bin of class j takes just j pieces, whatever they
are: no fit is ever searched. Workers keep one open bin a class (fewer than 2 sqrt(capacity) classes exist) and fill theirs independently, in one pass over the texts.
Documents are cut so that bins come out nearly full: capacity by capacity, and what is left either nearly fills its class's share or gives off
a share of the next class, capacity / (j + 1), leaving a rest that is j times shorter than what it was cut from. Pieces of bins that stay open are gathered from a few
workers at a time and fill bins again, until one task has the last few, which are joined end to end.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievespark.llm.common import checkpointed, sliced, table, values

#: Tokens of a sequence, the id that ends a document, and the padding that a bin of equal pieces may have before a piece is cut again.
CAPACITY, END, SLACK = 2048, 1, 32
#: Workers whose open bins one worker goes on with.
FAN = 8
#: Texts read at a time, chunks of text that a worker remembers, the longest of them, and tokens of a batch it hands on.
TEXTS, CACHED, KEPT, TOKENS = 64, 1 << 18, 64, 1 << 19
#: Lower-case letters whose words are sent to the merges directly. Their capitals, however composed, normalise to them.
_LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_MARKS = ",.;:!?"
_WORD = re.compile(f"([{_LETTERS}]{{1,64}})([{_MARKS}]?)").fullmatch
_COLUMNS = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]


@lru_cache(2)
def _tokenizer(path: str) -> Chunks:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Chunks(Tokenizer.from_file(path))


class Chunks(dict):
    """Ids of texts as little-endian 32-bit bytes, by their chunks between blanks: the tokenizer parts words at white space, so a text's ids are those of its chunks in order.

    Chunks met lately are remembered in two generations: when the newer one is full it becomes the older one, and what is met again moves over. A chunk of Latin letters, with at most a mark after them, is
    one word, which goes to the tokenizer's merges at once if that is found to give the same ids at the start; any other goes through all of the tokenizer.
    """

    def __init__(self, tokenizer):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenizer, self.old = tokenizer, {}
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges, self.letters = tokenizer.model, {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        some = [*_LETTERS, *("".join(_LETTERS[(i * j + i) % len(_LETTERS)] for j in range(9)) for i in range(500))]
        self.marks = dict(zip(["", *_MARKS], self.whole(["", *_MARKS]), strict=True))
        self.direct = [self.word(c) for c in some] == self.whole(some)

    def word(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(letters.translate(self.letters))]).tobytes()

    def whole(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def __missing__(self, chunk: str) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            plain = _WORD(chunk.lower()) if self.direct else None
            if plain:
                word, mark = plain.groups()
                found = self.word(word) if chunk == word else self[word] + self.marks[mark]
            else:
                found = self.whole([chunk])[0]
        if len(chunk) <= KEPT:
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()
        return b"".join([self[c] for c in (text.lower() if text.isascii() else text).replace("\n", " ").split(" ")])


def cuts(n: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full sequences, then shares of a sequence. A bin of the last kind wastes at most slack tokens; the others, what division leaves."""
    out, at = [(i, capacity) for i in range(0, n - capacity + 1, capacity)], n - n % capacity
    while at < n:
        j = capacity // (n - at)
        length = n - at if capacity - j * (n - at) <= slack else capacity // (j + 1)
        out.append((at, length))
        at += length
    return out


class Bins:
    """The open bins of a worker, one a class, and the numbers of its sequences."""

    def __init__(self, worker: int, capacity: int):
        self.capacity, self.open, self.next = capacity, {}, worker << 32

    def close(self, pieces: list[tuple]) -> list[tuple]:
        """The pieces end to end as a sequence of their own."""
        out, at = [], 0
        for doc_id, start, ids, whole in pieces:
            out.append((doc_id, start, ids, whole, self.next, at))
            at += len(ids) // 4
        self.next += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """The bin that the piece completes, if any."""
        share = self.capacity // (len(piece[2]) // 4)
        some = self.open.setdefault(share, [])
        some.append(piece)
        return self.close(self.open.pop(share)) if len(some) == share else []

    def joined(self) -> Iterator[tuple]:
        """What is left, end to end, cut at the capacity; the last sequence in lengths that are powers of two, which need no padding."""
        rest = [p for share in sorted(self.open) for p in self.open[share]]
        left = sum(len(p[2]) // 4 for p in rest)
        some, room = [], self._room(left)
        for doc_id, start, ids, whole in rest:
            at = 0
            while at < len(ids):
                part = ids[at : at + 4 * room]
                some.append((doc_id, start + at // 4, part, whole))
                at, room, left = at + len(part), room - len(part) // 4, left - len(part) // 4
                if not room:
                    yield from self.close(some)
                    some, room = [], self._room(left)

    def _room(self, left: int) -> int:
        return self.capacity if left >= self.capacity else 1 << left.bit_length() - 1 if left else 0


def _handed_on(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[2])
        if size >= 4 * TOKENS or len(some) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema(list(zip(_COLUMNS, [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()], strict=True)))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, slack: int = SLACK) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): the pieces of all documents (doc_id, text), each with its place in a sequence of at most capacity tokens.

    ids: the piece's ids as little-endian unsigned 32-bit integers; start: ids of the document before it; doc_tokens: those of the whole document, whose last is `end`.
    Pieces of a sequence lie without gaps from offset 0. A null, empty or blank text is `end` alone. Texts of any length are taken whole. Repeated rows and ids, null ones too, are
    documents of their own. Other columns don't matter. No documents: no rows. path is the tokenizer's file, which every executor must have; it has to part words at white space.
    A sequence is padded by at most slack tokens or the root of the capacity. Sequences are numbered by worker, so numbers have gaps.
    """
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, ids binary, doc_tokens long, sequence_id long, offset long"

    def texts(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[tuple]:
        tokens, last = _tokenizer(path), end.to_bytes(4, "little")
        for batch in sliced(batches, TEXTS):
            for doc_id, text in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
                ids = tokens.encode(text or "") + last
                for start, length in cuts(len(ids) // 4, capacity, slack):
                    yield from bins.add((doc_id, start, ids[4 * start : 4 * (start + length)], len(ids) // 4))

    def opened(batches: Iterator[pa.RecordBatch], bins: Bins) -> Iterator[tuple]:
        for batch in sliced(batches, 4096):
            for piece in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                yield from bins.add(piece)

    def filled(read, first: int, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bins, schema = Bins(first + TaskContext.get().partitionId(), capacity), None

            def seen() -> Iterator[pa.RecordBatch]:
                nonlocal schema
                for batch in batches:
                    schema = schema or _schema(batch.schema.field(0).type)
                    yield batch

            def rows() -> Iterator[tuple]:
                yield from read(seen(), bins)
                if final:
                    yield from bins.joined()
                else:
                    yield from ((*p, None, None) for some in bins.open.values() for p in some)

            placed = rows()
            one = next(placed, None)
            if one is not None:
                yield from _handed_on((r for rest in ([one], placed) for r in rest), schema)

        return run

    rows = docs.select("doc_id", "text")
    out = checkpointed(rows.mapInArrow(filled(texts, 0, False), kind))
    done, first = out.where("sequence_id is not null"), 0
    while True:
        left = checkpointed(out.where("sequence_id is null").select(*_COLUMNS[:4]))
        before = (left.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0) + 1
        first, workers = first + before, -(-before // FAN)
        out = checkpointed(left.coalesce(workers).mapInArrow(filled(opened, first, workers == 1), kind))
        done = done.unionByName(out.where("sequence_id is not null"))
        if workers == 1:
            return done


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
