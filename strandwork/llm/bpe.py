"""Byte-pair encoding of whole texts with a public rank vocabulary (problem 5).

Two parts, both exact:

* :func:`piece_starts` splits a batch of texts into pre-tokens with array operations over
  the code points of the whole batch. It finds the same pieces as the vocabulary's pattern
  (contractions, letters, digits, other marks, white space, one leading blank).
* :class:`RankQueueEncoder` merges the bytes of one pre-token with a hierarchical-bitmap
  rank queue: one bucket of linked-list positions per merge rank, a two-level bitmap whose
  find-first-set yields the lowest waiting rank, and stale entries skipped when popped. Its
  cost is near-linear in the length, so pre-tokens of any length are encoded whole.

Nulls and empty texts give an empty list. Strings that look like special tokens are
ordinary text. Repeated rows each give a row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType

from strandwork.runtime import spread

BATCH_CHARS = 1 << 21
CACHE_PIECES = 400_000
WORD = 256
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
MIX_LOW, MIX_HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)

# The code points with Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    """Class of every code point: other, letter, digit, white space."""
    global _classes
    if _classes is None:
        every = "".join("\0" if 0xD800 <= i < 0xE000 else chr(i) for i in range(0x110000))
        out = np.zeros(0x110000, dtype=np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[m.start() : m.end()] = kind
        out[WHITE_SPACE] = SPACE
        _classes = out
    return _classes


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start in texts laid end to end.

    ``points``: code points of all texts; ``text_starts``: where each non-empty text starts.
    """
    n = len(points)
    kind = char_classes()[points]
    first = np.zeros(n + 1, dtype=bool)
    first[text_starts] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # A white-space run before more text gives its last character away: a blank joins
    # the next piece, any other character stands alone.
    bounds = np.flatnonzero(start)
    begin, end = bounds[:-1], bounds[1:]
    runs = (kind[begin] == SPACE) & ~first[end]
    last = end[runs] - 1
    start[last] = True
    start[end[runs][points[last] == 32]] = False
    # Contractions: a lone apostrophe that starts a piece and is followed by its letters.
    quote = np.flatnonzero((points == 39) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        one = points[quote + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        at = quote[short]
        start[at + 1] = False
        start[at + 2] = True
        rest = quote[~short]
        rest = rest[rest + 2 < n]
        rest = rest[~first[rest + 2]]
        one, two = points[rest + 1], points[rest + 2]
        long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
        at = rest[long]
        start[at + 1] = False
        start[at + 3] = True
    return np.flatnonzero(start[:n])


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one ``base64(token) rank`` per line. Its size is that of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def split_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every way to join two tokens into a third: ``left << 20 | right`` and the rank of the whole."""
    keys, values = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 20 | right)
                values.append(rank)
    return np.array(keys, dtype=np.int64), np.array(values, dtype=np.int32)


class RankQueueEncoder:
    """Encodes texts with a rank vocabulary; keeps bounded caches of encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], splits: tuple[np.ndarray, np.ndarray] | None = None):
        keys, values = splits or split_table(ranks)
        self.ranks = ranks
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = dict(zip(keys.tolist(), values.tolist()))
        self.bigrams = [self.pairs.get(self.byte[a] << 20 | self.byte[b], -1) for a in range(256) for b in range(256)]
        self.words = [0] * (max(ranks.values()) // WORD + 1)
        self._reset()

    def _reset(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.sizes: list[int] = []
        self.pool: list[int] = []
        self.slot_low = np.zeros(SLOTS, dtype=np.uint64)
        self.slot_high = np.zeros(SLOTS, dtype=np.uint64)
        self.slot_size = np.zeros(SLOTS, dtype=np.uint8)
        self.slot_index = np.full(SLOTS, -1, dtype=np.int32)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        pair, words, bigrams, byte = self.pairs.get, self.words, self.bigrams, self.byte
        n = len(piece)
        ids = [byte[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waits = [bigrams[a << 8 | b] for a, b in zip(piece, piece[1:])]
        waits.append(-1)
        buckets: dict[int, list[int]] = {}
        top = 0
        for i, rank in enumerate(waits):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            bit = bits & -bits
            rank = word << 8 | (bit.bit_length() - 1)
            bucket = buckets[rank]
            i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[word] = bits = bits ^ bit
                if not bits:
                    top ^= 1 << word
            if waits[i] != rank:
                continue  # stale: the pair at this position is another one by now, or gone
            ids[i] = rank
            j = after[i]
            ids[j] = waits[j] = -1
            k = after[i] = after[j]
            around = []
            if k < n:
                before[k] = i
                waits[i] = new = pair(rank << 20 | ids[k], -1)
                if new >= 0:
                    around.append((i, new))
            else:
                waits[i] = -1
            h = before[i]
            if h >= 0:
                waits[h] = new = pair(ids[h] << 20 | rank, -1)
                if new >= 0:
                    around.append((h, new))
            for i, new in around:
                if new in buckets:
                    heappush(buckets[new], i)
                else:
                    buckets[new] = [i]
                    words[new >> 8] |= 1 << (new & 255)
                    top |= 1 << (new >> 8)
        return [t for t in ids if t >= 0]

    def _indices(self, data: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Place of each piece ``data[begin:stop]`` in the list of encoded pieces.

        Pieces of up to 16 bytes are looked up, compared byte for byte, in a direct-mapped
        table by array operations; what it misses, and longer pieces, go through a dict.
        """
        size = stop - begin
        padded = data + b"\0" * 16
        loads = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        low = loads[begin] & KEEP[np.minimum(size, 8)]
        high = loads[begin + 8] & KEEP[np.clip(size - 8, 0, 8)]
        slot = ((low * MIX_LOW) ^ (high * MIX_HIGH) ^ size.astype(np.uint64)) * MIX_LOW >> np.uint64(64 - SLOT_BITS)
        slot = slot.astype(np.int64)
        hit = (self.slot_low[slot] == low) & (self.slot_high[slot] == high) & (self.slot_size[slot] == size)
        index = np.where(hit, self.slot_index[slot], -1).astype(np.int64)
        miss = np.flatnonzero(index < 0)
        seen, counts, pool = self.seen, self.sizes, self.pool
        placed = []
        for a, b in zip(begin[miss].tolist(), stop[miss].tolist()):
            piece = data[a:b]
            k = seen.get(piece)
            if k is None:
                merged = self.merge(piece)
                k = seen[piece] = len(counts)
                counts.append(len(merged))
                pool.extend(merged)
            placed.append(k)
        index[miss] = placed
        keep = miss[size[miss] <= 16]
        self.slot_low[slot[keep]] = low[keep]
        self.slot_high[slot[keep]] = high[keep]
        self.slot_size[slot[keep]] = size[keep]
        self.slot_index[slot[keep]] = index[keep]
        return index

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Token count per text and, if asked for, all ids end to end."""
        sizes = np.fromiter((len(t) if t else 0 for t in texts), dtype=np.int64, count=len(texts))
        per_text = np.zeros(len(texts), dtype=np.int64)
        if not sizes.sum():
            return per_text, np.zeros(0, dtype=np.int32)
        joined = "".join(t for t in texts if t)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum(sizes)
        text_starts = (ends - sizes)[sizes > 0]
        starts = piece_starts(points, text_starts)
        data = joined.encode("utf-8")
        if len(data) == len(points):
            begin = starts
        else:
            width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
            begin = (np.cumsum(width, dtype=np.int64) - width)[starts]
        index = self._indices(data, begin, np.append(begin[1:], len(data)))
        count = np.array(self.sizes, dtype=np.int64)
        each = count[index]
        per_text[sizes > 0] = np.add.reduceat(each, np.searchsorted(starts, text_starts))
        flat = None
        if ids:
            base = np.cumsum(count) - count
            out_at = np.cumsum(each) - each
            flat = np.array(self.pool, dtype=np.int32)[np.repeat(base[index] - out_at, each) + np.arange(int(each.sum()))]
        if len(self.seen) > CACHE_PIECES:
            self._reset()
        return per_text, flat


def chunks(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each (a longer text stands alone)."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


_encoders: dict[str, RankQueueEncoder] = {}


def shared_encoder(name: str, vocabulary: tuple) -> RankQueueEncoder:
    """One encoder per Python worker and vocabulary (named by its content), so its caches outlive a task."""
    if name not in _encoders:
        _encoders[name] = RankQueueEncoder(*vocabulary)
    return _encoders[name]


def broadcast_vocabulary(df: DataFrame, path: str):
    """The digest of a rank file, and its ranks and split table, read on the driver; their size is the vocabulary's."""
    with open(path, "rb") as file:
        digest = hashlib.sha256(file.read()).hexdigest()
    ranks = load_ranks(path)
    return digest, df.sparkSession.sparkContext.broadcast((ranks, split_table(ranks)))


def encode_texts(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (token ids of ``text``), one row per input row; other columns are left out.

    ``vocabulary`` is the path of a rank file, read on the driver and broadcast (its size is
    fixed by the vocabulary, not by the data).
    """
    name, ranks = broadcast_vocabulary(df, vocabulary)
    schema = df.select(key).schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(name, ranks.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                count, flat = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, schema)


def count_tokens(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``n_tokens`` of ``text`` (0 for null and empty texts), one row per input row."""
    name, ranks = broadcast_vocabulary(df, vocabulary)
    schema = df.select(key).schema.add("n_tokens", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(name, ranks.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                count, _ = encoder.encode(texts[a:b], ids=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(count, pa.int64())], names=[key, "n_tokens"])

    return spread(df.select(key, text)).mapInArrow(run, schema)
