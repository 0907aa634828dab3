"""Byte-level BPE encoding and decoding without regular expressions.

Texts become arrays of code points; a table gives every code point a class, shifted comparisons turn classes into nine symbols
that look ahead as far as the pattern does, and the symbols' transition functions over eight states are composed
block by block (an associative scan): first every block's function from all states at once, then the states at the blocks' starts, then
all states inside. A token starts where the state asks for it. The slices feed a cache of merged pairs.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sievespark.llm.common import table

#: Fixed values of the pattern: the code points of \s, and the letters that may follow an apostrophe.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")

LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# Symbols: the classes with what they need to know of their right neighbours.
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_RUN, S_PREFIX, S_LAST, S_END = range(9)
# States: what the token that holds the last code point is; two and one code points of a contraction are left; nothing may join.
IN_LETTERS, IN_NUMBERS, IN_OTHERS, PREFIX, IN_WHITE, LEFT2, LEFT1, CLOSED = range(8)
#: Code points scanned at once, and the most merged slices a worker remembers.
CHUNK, CACHED = 1 << 18, 1 << 17
#: Texts that a task holds at a time.
ROWS = 512


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here) by symbol and state."""
    step, begins = np.zeros((9, 8), np.uint8), np.zeros((9, 8), bool)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS, S_SHORT: IN_OTHERS, S_LONG: IN_OTHERS}
    alone = {S_SHORT: LEFT1, S_LONG: LEFT2}
    for symbol in range(9):
        for state in range(8):
            if symbol == S_END:
                step[symbol, state] = CLOSED
            elif state in (LEFT1, LEFT2):
                step[symbol, state] = CLOSED if state == LEFT1 else LEFT1
            elif symbol in runs:
                joins = state in (runs[symbol], PREFIX)
                step[symbol, state], begins[symbol, state] = runs[symbol] if joins else alone.get(symbol, runs[symbol]), not joins
            elif symbol == S_RUN:
                step[symbol, state], begins[symbol, state] = IN_WHITE, state != IN_WHITE
            else:
                step[symbol, state], begins[symbol, state] = PREFIX if symbol == S_PREFIX else CLOSED, True
    return step, begins


STEP, BEGINS = _automaton()


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[SPACES] = WHITE
    out[0x20] = SPACE
    return out


def _symbols(points: np.ndarray) -> np.ndarray:
    """points hold a zero-length gap as 0xFFFFFFFF between texts and at the end."""
    gap = points == 0xFFFFFFFF
    kind = _classes()[np.where(gap, 0, points)]
    out = np.take(np.array([S_LETTER, S_NUMBER, S_OTHER, S_LAST, S_LAST], np.uint8), kind)
    white = (kind >= SPACE) & ~gap
    after = np.append(points[1:], 0xFFFFFFFF).astype(np.uint32)
    after2 = np.append(after[1:], 0xFFFFFFFF).astype(np.uint32)
    run = white & np.append(white[1:] | gap[1:], True)
    out[white & (kind == SPACE)] = S_PREFIX
    out[run] = S_RUN
    quote = points == 0x27
    if quote.any():
        out[quote & np.isin(after, [ord(c) for c in SHORT])] = S_SHORT
        for a, b in LONG:
            out[quote & (after == ord(a)) & (after2 == ord(b))] = S_LONG
    out[gap] = S_END
    return out


def token_starts(points: np.ndarray) -> np.ndarray:
    """True at each code point that starts a pre-token; gaps never do."""
    symbols, n = _symbols(points), len(points)
    lanes = int(max(1, min(4096, n // 64)))
    length = -(-n // lanes)
    grid = np.full(lanes * length, S_END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, length).T).astype(np.int64) * 8
    flat = STEP.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8)).copy()
    for row in grid:  # the function of every block, from all states at once
        whole = flat[row[:, None] + whole]
    entry = np.empty(lanes, np.uint8)
    state = CLOSED
    for i, function in enumerate(whole):
        entry[i] = state
        state = function[state]
    states = np.empty((length, lanes), np.uint8)
    state = entry
    for i, row in enumerate(grid):
        states[i] = state
        state = flat[row + state]
    return BEGINS.ravel()[(grid + states).T.ravel()[:n]]


@lru_cache(2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Merger(dict):
    """Slice of text -> its ids as little-endian 32-bit bytes; merges on a miss and forgets all when full."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHED):
        super().__init__()
        self.ranks, self.most = ranks, most
        self.names = [b""] * (max(ranks.values(), default=-1) + 1)
        for name, rank in ranks.items():
            self.names[rank] = name
        self.lengths = np.array([len(x) for x in self.names], np.int64)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        rank = self.ranks.get(raw)
        ids = [rank] if rank is not None else self.merged(raw)
        out = np.array(ids, "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(raw) <= 256:
            self[piece] = out
        return out

    def merged(self, raw: bytes) -> list[int]:
        """Joins the neighbours of lowest rank, leftmost first, until none is left."""
        ranks, n = self.ranks, len(raw)
        if n > 48:
            return self.merged_long(raw)
        parts = [raw[i : i + 1] for i in range(n)]
        near = [ranks.get(parts[i] + parts[i + 1], 1 << 60) for i in range(n - 1)]
        while near:
            low = min(near)
            if low == 1 << 60:
                break
            i = near.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[p] for p in parts]

    def merged_long(self, raw: bytes) -> list[int]:
        """The same with a heap over linked neighbours, for slices of any length."""
        ranks, n = self.ranks, len(raw)
        end, back = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if mid is None or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, None
            if stop < n:
                back[stop] = i
                if (r := ranks.get(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (j := back[i]) >= 0 and (r := ranks.get(raw[j:stop])) is not None:
                heapq.heappush(heap, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = end[i]
        return out


@lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(_ranks(path))


def _chunks(texts: list[str], most: int) -> Iterator[list[str]]:
    at, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield texts[at:i]
            at, held = i, 0
        held += len(text) + 1
    yield texts[at:]


def encode(texts: list[str], path: str) -> list[bytes]:
    """The ids of every text as little-endian 32-bit bytes."""
    table, out = merger(path), []
    for some in _chunks(texts, CHUNK):
        lengths = np.fromiter(map(len, some), np.int64, len(some))
        ends = np.cumsum(lengths + 1)
        points = np.full(int(ends[-1]) if len(some) else 0, 0xFFFFFFFF, np.uint32)
        inside = np.ones(len(points), bool)
        inside[ends - 1] = False
        points[inside] = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        starts = np.flatnonzero(token_starts(points)) if len(points) else np.zeros(0, np.int64)
        first = np.searchsorted(starts, ends - lengths - 1)
        last = np.append(first[1:], len(starts))
        for text, base, a, b in zip(some, (ends - lengths - 1).tolist(), first.tolist(), last.tolist(), strict=True):
            cut = (starts[a:b] - base).tolist()
            out.append(b"".join([table[text[i:j]] for i, j in zip(cut, [*cut[1:], len(text)], strict=True)]) if cut else b"")
    return out


def offsets(ids: np.ndarray, path: str) -> np.ndarray:
    """The byte at which every token starts, and the length of all."""
    return np.concatenate([[0], np.cumsum(merger(path).lengths[ids])])


def decode(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids, each at its own offset."""
    names = merger(path).names
    out = b"".join([names[i] for i in ids.tolist()])
    if len(out) != offsets(ids, path)[-1]:
        raise ValueError("token offsets and decoded bytes disagree")
    return out


def encoded(df: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for documents (doc_id, text); with ids also ids and offsets, arrays of int.

    A null text counts as empty: no tokens, the hashes of nothing. A row for each row, whatever doc_id it bears; other columns don't
    matter. Texts of any length are taken whole. path is the vocabulary file, which every executor must have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            keys = batch.column(0)
            at = 0
            for some in _chunks(texts, 4 * CHUNK):
                packed = encode(some, path)
                arrays = [np.frombuffer(x, "<u4") for x in packed]
                cols = [
                    keys.slice(at, len(some)),
                    pa.array([len(a) for a in arrays], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(decode(a, path)).hexdigest() for a in arrays], pa.string()),
                ]
                if ids:
                    cols += [pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())), pa.array([offsets(a, path)[:-1].astype(np.int32) for a in arrays], pa.list_(pa.int32()))]
                at += len(some)
                yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "offsets"]
    kind = dict(df.dtypes)["doc_id"]
    return df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, offsets array<int>" * ids)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary())
