"""A broadcast bit map (Bloom filter) of bounded size that thins a scan before a join.

The map holds the keys of the smaller side. Rows it lets through are joined as usual, so it
only ever saves work: false positives are dropped by the join, and once the keys outgrow
``MAX_BITS`` it merely lets more rows through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BITS = 1 << 29
MIN_BITS = 1 << 16
BITS_PER_KEY = 24
_PROBES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def bits_for(keys: int) -> int:
    """A power of two of at least ``BITS_PER_KEY`` bits a key, within the bounds."""
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_KEY * max(1, keys)).bit_length()))


def probe(keys: np.ndarray, bits: int, which: int) -> np.ndarray:
    """The bit of each key by one of the three probes."""
    m = _PROBES[which]
    x = keys * m
    return ((x ^ (x >> np.uint64(32))) * m) >> np.uint64(64 - (bits.bit_length() - 1))


CHUNK_WORDS = 1 << 13


def bit_map(keys: DataFrame, bits: int, key: str = "key") -> np.ndarray:
    """The map of a BIGINT column, made in chunks of ``CHUNK_WORDS`` words by the executors.

    What reaches the driver is the map itself: at most ``bits / 8`` bytes, 64 MB by the size bound.
    """
    size = min(CHUNK_WORDS, max(1, bits // 64))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([probe(values, bits, i) for i in range(len(_PROBES))]))
            chunk, begin = np.unique((at // np.uint64(64 * size)).astype(np.int32), return_index=True)
            held = [at[x:y].tobytes() for x, y in zip(begin, np.append(begin[1:], len(at)))]
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(held, pa.binary())], names=["chunk", "at"])

    def merge(rows: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(rows.column("at").to_pylist()), dtype=np.uint64) % np.uint64(64 * size)
        marked = np.zeros(64 * size, dtype=np.uint8)
        marked[at] = 1
        words = np.packbits(marked, bitorder="little").tobytes()
        return pa.table({"chunk": rows.column("chunk").slice(0, 1), "words": pa.array([words], pa.binary())})

    made = keys.select(key).mapInArrow(mark, "chunk int, at binary").groupBy("chunk").applyInArrow(merge, "chunk int, words binary").toArrow()
    out = np.zeros(max(1, bits // 64), dtype=np.uint64)
    for chunk, words in zip(made.column("chunk").to_pylist(), made.column("words").to_pylist()):
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(words, dtype=np.uint64)
    return out


def present(words: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the keys (unsigned) that the map may hold."""
    at = None
    for i in range(len(_PROBES)):
        bit = probe(keys if at is None else keys[at], bits, i)
        held = np.flatnonzero((words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
        at = held if at is None else at[held]
    return at


def thin(df: DataFrame, words: np.ndarray, bits: int, key: str) -> DataFrame:
    """The rows of ``df`` whose BIGINT ``key`` may be in the map."""
    shared = df.sparkSession.sparkContext.broadcast(words)
    place = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = present(shared.value, batch.column(place).to_numpy().view(np.uint64), bits)
            if len(held):
                yield batch.take(pa.array(held))

    return df.mapInArrow(run, df.schema)
