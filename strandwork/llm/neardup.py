"""Near-duplicate records with small edits, insertions or moved pieces (problem 3).

Records are compared by the Jaccard similarity of their sets of runs of ``GRAM`` characters.

1. Records with equal canonical sequences are one *class* and are compared once.
2. *Candidates.* Per class ``BANDS x ROWS`` MinHash values; classes that agree in a whole
   band are candidates. At similarity ``s`` a pair escapes all bands with probability
   ``(1 - s^ROWS)^BANDS``: 9.6e-6 at the threshold 0.5, far less above. Candidates stay near
   the number of true pairs: 1.01 to 1.18 times it for one thousand to 118 thousand classes.
   Band keys are first counted (as blocks of sorted keys, combined per batch), and only keys
   that occur twice become rows, thinned by a bit map of bounded size.
3. *Bayesian pruning.* MinHash values (``CHECKS`` of them, a byte each) are compared ``STEP`` at a
   time. After each step the posterior probability (uniform prior) that the similarity
   reaches the threshold is a function of the matches so far; pairs below ``TOLERANCE`` are
   dropped, so unrelated pairs cost a step or two. The values are those of the first bands: agreeing in a band
   only makes more of them match, so a similar pair is pruned less often still. Sequences are joined to the
   pairs that remain.
4. The rest is verified exactly on the gram sets.

Large buckets, and large groups of copies, are split into chunks that are paired two at a time, so that no task
holds a whole one. Null and empty sequences are left out; a
sequence without runs (shorter than ``GRAM``) only matches an equal one. A chain with
several sequences matches by any of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.hashing import content_key
from strandwork.functions.sequence import normalised
from strandwork.llm.bits import bit_map, bits_for, present
from strandwork.llm.pairing import pairs_within
from strandwork.runtime import fan_out, settle

GRAM = 5
THRESHOLD = 0.5
BANDS, ROWS = 179, 4
CHECKS, STEP = 64, 16  # CHECKS is at most BANDS x ROWS
TOLERANCE = 1e-6
CHUNK = 256
BLOCK, STRIP = 4096, 1 << 16
BATCH_CHARS = 1 << 18
SHARD_KEYS = 1 << 21


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def min_hashes(sequences: list[str], seed: int = 71) -> np.ndarray:
    """32-bit MinHash values of sequences of at least ``GRAM`` characters: one row a value.

    Grams are mixed once; each value orders them by another odd multiplier.
    """
    points = np.frombuffer("".join(sequences).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(s) for s in sequences])
    starts = np.cumsum(sizes) - sizes
    gram = np.zeros(len(points) - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        gram = gram * np.uint64(0x100000001B3) + points[i : len(points) - GRAM + 1 + i]
    inside = np.ones(len(gram), dtype=bool)
    for back in range(1, GRAM):
        inside[(starts[1:] - back)] = False
    mixed = (_mixed(gram[inside]) >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(sizes - GRAM + 1) - (sizes - GRAM + 1)
    out, ordered = np.empty((BANDS * ROWS, len(sequences)), dtype=np.uint32), np.empty_like(mixed)
    for i, m in enumerate(_multipliers(len(out), seed)):
        np.multiply(mixed, m, out=ordered)
        out[i] = np.minimum.reduceat(ordered, first)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band (rows) and sequence (columns)."""
    keys = np.empty((BANDS, values.shape[1]), dtype=np.int64)
    for b in range(BANDS):
        key = np.full(values.shape[1], b + 1, dtype=np.uint64)
        for r in range(ROWS):
            key *= np.uint64(0x9E3779B97F4A7C15)
            key += values[b * ROWS + r]
        keys[b] = _mixed(key).view(np.int64)
    return keys


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """``(values compared, least matches to go on)`` after each step.

    With a uniform prior the posterior after ``m`` of ``n`` matches is Beta(m + 1, n - m + 1),
    whose upper tail at ``t`` is the binomial probability of at most ``m`` out of ``n + 1``.
    """
    out = []
    for n in range(STEP, CHECKS + 1, STEP):
        tail, m = 0.0, -1
        while m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
        out.append((n, m))
    return out


def signatures(classes: DataFrame) -> DataFrame:
    """``k1, k2, bands, checks``: band keys and one byte of each check value, per class.

    One byte makes a chance match of 1/256 per value: pruning becomes a little more cautious.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) < BATCH_CHARS):
                    size += len(texts[end])
                    end += 1
                values = min_hashes(texts[begin:end])
                keys = band_keys(values).T.reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
                checks = np.ascontiguousarray((values[:CHECKS] >> np.uint32(8)).astype(np.uint8).T)
                held = pa.array([row.tobytes() for row in checks], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), batch.column(1).slice(begin, end - begin), lists, held], names=["k1", "k2", "bands", "checks"])
                begin = end

    return fan_out(classes.where(F.length("norm") >= GRAM).select("k1", "k2", "norm")).mapInArrow(run, "k1 long, k2 long, bands array<long>, checks binary")


def repeated_keys(signed: DataFrame) -> DataFrame:
    """``band, n`` of the band keys that more than one class has.

    Every batch sorts its keys, combines equal ones and cuts them by hash into shards of about
    ``SHARD_KEYS``; the blocks of a shard are merged in one group. A key enters once per batch, however hot.
    """
    shards = max(1, -(-signed.count() * BANDS // SHARD_KEYS))
    shards = max(shards, signed.sparkSession.sparkContext.defaultParallelism)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(batch.column(0).flatten().to_numpy().view(np.uint64), return_counts=True)
            # keys are hashes: equal ranges of them hold about as many each
            place = ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
            named, begin = np.unique(place, return_index=True)
            rows = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)]):
                often = np.flatnonzero(counts[a:b] > 1) + a
                rows.append((keys[a:b].tobytes(), keys[often].tobytes(), counts[often].tobytes()))
            columns = [pa.array(list(c), pa.binary()) for c in zip(*rows)] or [pa.array([], pa.binary())] * 3
            yield pa.RecordBatch.from_arrays([pa.array(named), *columns], names=["shard", "keys", "often", "counts"])

    def merge(rows: pa.Table) -> pa.Table:
        keys, often, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("keys", np.uint64), ("often", np.uint64), ("counts", np.int64)))
        keys = np.sort(keys)
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(begin, len(keys)))
        keys = keys[begin]
        np.add.at(n, np.searchsorted(keys, often), counts - 1)
        return pa.table({"band": keys[n > 1].view(np.int64), "n": n[n > 1]})

    blocks = signed.select("bands").mapInArrow(cut, "shard int, keys binary, often binary, counts binary")
    return fan_out(blocks, "shard").groupBy("shard").applyInArrow(merge, "band long, n long")


def held_bands(signed: DataFrame, repeated: DataFrame) -> DataFrame:
    """``k1, k2, band``: the bands of each class that other classes (nearly always) have as well."""
    bits = bits_for(repeated.count())
    shared = signed.sparkSession.sparkContext.broadcast(bit_map(repeated, bits, "band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            at = present(shared.value, keys.view(np.uint64), bits)
            own = pa.array(at // BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(keys[at])], names=["k1", "k2", "band"])

    return signed.select("k1", "k2", "bands").mapInArrow(run, "k1 long, k2 long, band long")


def signed_members(signed: DataFrame, hot: DataFrame) -> DataFrame:
    """``band, k1, k2, bands, checks`` of the classes that (nearly always) have a band of ``hot``: only they are moved."""
    bits = bits_for(hot.count())
    shared = signed.sparkSession.sparkContext.broadcast(bit_map(hot, bits, "band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).flatten().to_numpy()
            at = present(shared.value, keys.view(np.uint64), bits)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), *(c.take(pa.array(at // BANDS)) for c in batch.columns)], names=["band", "k1", "k2", "bands", "checks"])

    return signed.select("k1", "k2", "bands", "checks").mapInArrow(run, "band long, k1 long, k2 long, bands array<long>, checks binary")


def candidate_pairs(signed: DataFrame) -> DataFrame:
    """``a1, a2, b1, b2`` of class pairs (a before b) that agree in a band, each once.

    A bucket with more than ``CHUNK`` members is split into chunks, and each pair of chunks is
    one group, so it spreads over many tasks (:func:`hot_pairs`). There the pairs that pruning
    would drop are left out at once; nothing else is, and nothing is capped.
    """
    repeated = settle(repeated_keys(signed), "dup-repeated-bands")
    members = settle(held_bands(signed, repeated), "dup-members-of-bands")
    hot = settle(repeated.where(F.col("n") > CHUNK), "dup-hot-bands")
    some = not hot.isEmpty()
    usual = members.join(hot, "band", "left_anti") if some else members
    a = usual.select("band", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = usual.select("band", F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    pairs = a.join(b, "band").where("a1 < b1 OR (a1 = b1 AND a2 < b2)").select("a1", "a2", "b1", "b2")
    if some:
        pairs = pairs.unionByName(hot_pairs(signed_members(signed, hot).join(hot, "band")))
    return pairs.distinct()


def hot_pairs(members: DataFrame) -> DataFrame:
    """Pairs inside each large ``band`` that no step prunes. ``members``: ``band, n, k1, k2, bands, checks``.

    A pair is put out only under the first band it agrees in, so a family of near copies
    doesn't come out once per band.
    """
    steps = least_matches()
    parts = F.ceil(F.col("n") / BLOCK)
    placed = members.withColumn("own", F.pmod(F.xxhash64("k1", "k2"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)))
    placed = placed.select("band", "k1", "k2", "bands", "checks", "own", F.least("own", "other").alias("ca"), F.greatest("own", "other").alias("cb"))

    def pair_up(pdf: pd.DataFrame) -> pd.DataFrame:
        band, ca, cb = (pdf[c].iloc[0] for c in ("band", "ca", "cb"))
        keys = pdf[["k1", "k2"]].to_numpy(dtype=np.int64)
        bands = np.stack(pdf["bands"].to_numpy())
        checks = np.frombuffer(b"".join(pdf["checks"]), dtype=np.uint8).reshape(len(pdf), CHECKS)
        own = pdf["own"].to_numpy()
        left, right = np.flatnonzero(own == ca), np.flatnonzero(own == cb)
        out = [np.empty((0, 4), dtype=np.int64)]
        (first, least), columns = steps[0], np.ascontiguousarray(checks[right].T)
        strip = max(1, STRIP // max(1, len(right)))
        for begin in range(0, len(left), strip):
            rows = left[begin : begin + strip]
            matches = np.zeros((len(rows), len(right)), dtype=np.uint8)
            for c in range(first):
                matches += checks[rows, c, None] == columns[c]
            i, j = np.nonzero(matches >= least)
            i, j = rows[i], right[j]
            if ca == cb:
                i, j = i[i < j], j[i < j]
            alive = _alive(checks[i], checks[j], steps)
            i, j = i[alive], j[alive]
            agree = bands[i] == bands[j]
            lead = bands[i, agree.argmax(axis=1)] == band
            i, j = i[lead], j[lead]
            swap = (keys[i, 0] > keys[j, 0]) | ((keys[i, 0] == keys[j, 0]) & (keys[i, 1] > keys[j, 1]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            out.append(np.hstack([keys[i], keys[j]]))
        return pd.DataFrame(np.concatenate(out), columns=["a1", "a2", "b1", "b2"])

    return fan_out(placed, "band", "ca", "cb").groupBy("band", "ca", "cb").applyInPandas(pair_up, "a1 long, a2 long, b1 long, b2 long")


def similar(a: str, b: str, threshold: float = THRESHOLD) -> bool:
    """Exact check of two sequences."""
    x = {a[i : i + GRAM] for i in range(len(a) - GRAM + 1)}
    y = {b[i : i + GRAM] for i in range(len(b) - GRAM + 1)}
    common = len(x & y)
    return a == b or (common > 0 and common >= threshold * (len(x) + len(y) - common))


def surviving(a: list[bytes], b: list[bytes], steps: list[tuple[int, int]]) -> np.ndarray:
    """Positions of the pairs that no step prunes."""
    return _alive(*(np.frombuffer(b"".join(v), dtype=np.uint8).reshape(len(v), CHECKS) for v in (a, b)), steps)


def _alive(x: np.ndarray, y: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    alive, matches, done = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
    for n, least in steps:
        matches += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
        keep = matches >= least
        alive, matches, done = alive[keep], matches[keep], n
    return alive


def class_pairs(classes: DataFrame) -> DataFrame:
    """``a1, a2, b1, b2``: similar pairs of different classes. ``classes``: ``k1, k2, norm``."""
    classes = settle(classes, "dup-classes")
    signed = settle(signatures(classes), "dup-signatures")
    steps = least_matches()

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = surviving(batch.column(4).to_pylist(), batch.column(5).to_pylist(), steps)
                yield batch.select([0, 1, 2, 3]).take(pa.array(alive))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [similar(x, y) for x, y in zip(pdf["a_norm"], pdf["b_norm"])]
            yield pdf.loc[keep, ["a1", "a2", "b1", "b2"]]

    def beside(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(rows.select(F.col("k1").alias(f"{side}1"), F.col("k2").alias(f"{side}2"), F.col(column).alias(f"{side}_{column}")), [f"{side}1", f"{side}2"])
        return pairs.select("a1", "a2", "b1", "b2", f"a_{column}", f"b_{column}")

    ids = "a1 long, a2 long, b1 long, b2 long"
    alive = settle(beside(candidate_pairs(signed), signed, "checks").mapInArrow(prune, ids), "dup-alive")
    return fan_out(beside(alive, classes, "norm")).mapInPandas(verify, ids)


def chain_classes(chains: DataFrame, key: str = "chain_id", sequence: str = "sequence") -> DataFrame:
    """``chain_id, k1, k2, norm``: each chain with its class; null and empty sequences are left out."""
    k1, k2 = content_key(F.col("norm"))
    rows = chains.where(F.col(key).isNotNull() & (F.length(sequence) > 0)).select(F.col(key).alias("chain_id"), normalised(F.col(sequence)).alias("norm"))
    return rows.select("chain_id", k1.alias("k1"), k2.alias("k2"), "norm").distinct()


def near_duplicates(chains: DataFrame) -> DataFrame:
    """``chain_a, chain_b`` (a < b): pairs of different chains with similar or equal sequences, each once."""
    members = settle(chain_classes(chains), "dup-members")
    between = class_pairs(members.groupBy("k1", "k2").agg(F.first("norm").alias("norm")))
    a = members.select(F.col("chain_id").alias("x"), F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    b = members.select(F.col("chain_id").alias("y"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    apart = between.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y")
    within = pairs_within(members.select("chain_id", "k1", "k2"), ["k1", "k2"], ["chain_id"]).select(F.col("a_chain_id").alias("x"), F.col("b_chain_id").alias("y"))
    both = apart.unionByName(within).where(F.col("x") != F.col("y"))
    return both.select(F.least("x", "y").alias("chain_a"), F.greatest("x", "y").alias("chain_b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: connected components of ``a, b`` links, the root being the least node.

    Alternates large-star and small-star steps until nothing changes; each round is written
    to the shared folder. Hubs don't gather in one task: their links are grouped with
    map-side combine (only a minimum is needed) and joined back.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = settle(edges, "links-0")
    for i in range(1, most_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: the greater neighbours of u go to u's least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u <> v").distinct(), f"links-{i}-large")
        # small star: the lesser neighbours of u, and u, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = settle(small.where("u <> v").distinct(), f"links-{i}")
        mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        same = after.agg(F.count("*"), mark).first() == edges.agg(F.count("*"), mark).first()
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def duplicate_groups(chains: DataFrame) -> DataFrame:
    """``chain_id, group_id, links``: one row per chain with its group and its number of similar chains.

    Groups are the connected components of the similarity; ``group_id`` is the least chain id
    in it. Chains without a similar one are their own group; so are those without a sequence.
    """
    pairs = settle(near_duplicates(chains), "dup-pairs")
    found = components(pairs.select(F.col("chain_a").alias("a"), F.col("chain_b").alias("b")))
    links = pairs.select(F.explode(F.array("chain_a", "chain_b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    ids = chains.select("chain_id").where(F.col("chain_id").isNotNull()).distinct()
    return (
        ids.join(found.withColumnRenamed("node", "chain_id"), "chain_id", "left")
        .join(links.withColumnRenamed("node", "chain_id"), "chain_id", "left")
        .select("chain_id", F.coalesce("root", "chain_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
