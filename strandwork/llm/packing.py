"""Filling fixed-capacity containers with texts, with as little padding as possible (problem 6).

Bound-certified repacking:

1. Texts longer than the capacity are cut into full pieces, each a container of its own, and
   one rest; no other text is cut.
2. The rests and the shorter texts are spread by hash over partitions of about
   ``PARTITION_CONTAINERS`` containers. Each partition is packed best-fit decreasing: a bit set
   over the free rooms yields the tightest open container in one step.
3. Dual-feasible functions over the partition's size histogram give a lower bound of its
   containers. A partition that meets it is certified optimal and left alone.
4. Partitions with a gap exchange documents: the content of their containers that aren't full
   is pooled with that of other such partitions and packed again; a pool keeps the new packing
   only if it needs fewer containers. ``EXCHANGES`` rounds, with different pools.

Null and empty texts (0 tokens) are placed nowhere: their container and position are null.
The result doesn't depend on partitioning or order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.runtime import settle

PARTITION_CONTAINERS = 4096
POOL = 8
EXCHANGES = 2

ITEM = "capacity int, doc_id long, piece int, n_tokens int"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Container and offset of each item, and the number of containers. Ties go by position."""
    order = np.argsort(-sizes, kind="stable")
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = used = 0
    place, offset = [0] * len(sizes), [0] * len(sizes)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, at = capacity, used
            used += 1
        place[i], offset[i] = at, capacity - room
        room -= size
        if room:
            rooms[room].append(at)
            open_rooms |= 1 << room
    return np.array(place, dtype=np.int64), np.array(offset, dtype=np.int64), used


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that any packing needs, by two families of dual-feasible functions.

    For a limit ``l``: items above ``capacity - l`` count as full, items below ``l`` as nothing.
    For ``k``: an item counts ``floor((k + 1) size / capacity) / k``, or its own share where
    that product is whole. ``counts``: how often each size occurs, else once.
    """
    if not len(sizes):
        return 0
    histogram = np.bincount(sizes, weights=counts, minlength=capacity + 1).astype(np.int64)
    volume = histogram * np.arange(capacity + 1)
    items_to, volume_to = np.cumsum(histogram), np.cumsum(volume)
    limit = np.arange(0, capacity // 2 + 1)
    above = items_to[capacity] - items_to[capacity - limit]
    below = np.where(limit > 0, volume_to[np.maximum(limit - 1, 0)], 0)
    best = int(np.max(above * capacity + volume_to[capacity - limit] - below))
    bound = -(-best // capacity)
    size = np.arange(capacity + 1)
    for k in range(1, 33):
        whole = (k + 1) * size % capacity == 0
        value = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # times capacity * k
        bound = max(bound, -(-int((histogram * value).sum()) // (capacity * k)))
    return bound


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    sizes = pdf["n_tokens"].to_numpy().astype(np.int64)
    place, offset, used = best_fit_decreasing(sizes, capacity)
    pdf["bin"], pdf["position"] = place, offset
    pdf["fill"] = np.bincount(place, weights=sizes, minlength=used).astype(np.int64)[place]
    pdf["gap"] = used - lower_bound(sizes, capacity)
    pdf["home"] = pdf["part"]
    pdf["round"] = 0
    return pdf


def _exchange(pdf: pd.DataFrame, number: int) -> pd.DataFrame:
    before = pdf[["home", "round", "bin"]].drop_duplicates().shape[0]
    pdf = pdf.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    capacity = int(pdf["capacity"].iloc[0])
    sizes = pdf["n_tokens"].to_numpy().astype(np.int64)
    place, offset, used = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if used < before:
        pdf["bin"], pdf["position"], pdf["home"], pdf["round"] = place, offset, pdf["pool"], number
        pdf["fill"] = np.bincount(place, weights=sizes, minlength=used).astype(np.int64)[place]
        pdf["part"] = pdf["pool"]
    pdf["gap"] = min(used, before) - bound
    return pdf.drop(columns=["pool"])


def pool_of(part: Column, parts: Column, number: int) -> Column:
    """The pool of a partition in an exchange: neighbours first, then those a stride apart, about ``POOL`` each time."""
    return F.floor(part / POOL) if number == 1 else part % F.ceil(parts / POOL)


def _exchanger(number: int):
    return lambda pdf: _exchange(pdf, number)[_COLUMNS]


PACKED = f"{ITEM}, part long, bin long, position long, fill long, gap long, home long, round int"
_COLUMNS = [c.split()[0] for c in PACKED.split(", ")]


def stage_sizes(stages: DataFrame) -> DataFrame:
    """``stage, capacity``; stages without a name or a positive capacity are left out."""
    return stages.where("context_length > 0 AND name IS NOT NULL").groupBy(F.col("name").alias("stage")).agg(F.max("context_length").cast("int").alias("capacity"))


def packings(tokens: DataFrame, stages: DataFrame, exchanges: int = EXCHANGES, per_partition: int = PARTITION_CONTAINERS) -> tuple[DataFrame, list[DataFrame]]:
    """All pieces (``capacity, doc_id, piece, n_tokens``), and the packing of the loose ones after each round.

    Stages of the same capacity have the same packing, so there is one per distinct capacity (of
    which there are at most as many as rows of the plan table).
    """
    capacities = [r[0] for r in stage_sizes(stages).select("capacity").distinct().orderBy("capacity").collect()]
    n, c = F.coalesce(F.col("n_tokens"), F.lit(0)), F.col("capacity")
    pieces = F.greatest(F.lit(1), F.ceil(n / c)).cast("int")
    each = tokens.select("doc_id", "n_tokens", F.explode(F.array(*map(F.lit, capacities)).cast("array<int>")).alias("capacity"))
    items = each.select("capacity", "doc_id", n.alias("all"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"))
    items = items.select("capacity", "doc_id", "piece", F.least(F.col("capacity"), F.col("all") - F.col("piece") * F.col("capacity")).cast("int").alias("n_tokens"))
    items = settle(items, "pack-items")
    loose = items.where("n_tokens > 0 AND n_tokens < capacity")
    # one row per capacity: how many partitions it gets
    parts = loose.groupBy("capacity").agg(F.ceil(F.sum("n_tokens") / (F.first("capacity") * F.lit(per_partition))).cast("bigint").alias("parts"))
    spread = loose.join(F.broadcast(parts), "capacity").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.col("parts")))
    columns = [c for c in spread.columns if c != "parts"]
    rounds = [settle(spread.select(*columns).groupBy("capacity", "part").applyInPandas(lambda pdf: _pack(pdf)[_COLUMNS], PACKED), "pack-0")]
    for number in range(1, exchanges + 1):
        # partitions with a gap pool their containers that aren't full
        packed = rounds[-1]
        open_ = packed.where("gap > 0 AND fill < capacity").join(F.broadcast(parts), "capacity").withColumn("pool", pool_of(F.col("part"), F.col("parts"), number).cast("bigint")).drop("parts")
        done = packed.where("NOT (gap > 0 AND fill < capacity)")
        repacked = open_.groupBy("capacity", "pool").applyInPandas(_exchanger(number), PACKED)
        rounds.append(settle(done.unionByName(repacked), f"pack-{number}"))
    return items, rounds


def pack(tokens: DataFrame, stages: DataFrame, exchanges: int = EXCHANGES, per_partition: int = PARTITION_CONTAINERS) -> DataFrame:
    """``stage, doc_id, piece, n_tokens, container, position`` for every text and stage.

    ``tokens``: ``doc_id, n_tokens``; ``stages``: ``name, context_length`` (its few rows are
    broadcast). Stages without a name or a positive capacity are left out.
    """
    items, rounds = packings(tokens, stages, exchanges, per_partition)
    return _placed(items, rounds[-1]).join(F.broadcast(stage_sizes(stages)), "capacity").select("stage", "doc_id", "piece", "n_tokens", "container", "position")


def _placed(items: DataFrame, packed: DataFrame) -> DataFrame:
    place = ["capacity", "doc_id", "piece", "n_tokens"]
    placed = packed.select(*place, F.concat_ws("-", F.lit("b"), "round", "home", "bin").alias("container"), "position")
    alone = items.where("n_tokens = capacity").select(*place, F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container"), F.lit(0).cast("bigint").alias("position"))
    nowhere = items.where("n_tokens = 0").select(*place, F.lit(None).cast("string").alias("container"), F.lit(None).cast("bigint").alias("position"))
    return placed.unionByName(alone).unionByName(nowhere)


def packing_report(tokens: DataFrame, stages: DataFrame, exchanges: int = EXCHANGES, per_partition: int = PARTITION_CONTAINERS) -> DataFrame:
    """Per stage: capacity, items, containers, a lower bound of them, and the share of padding.

    The bound is that of the whole stage, from its size histogram (capacity + 1 rows at most).
    ``partitions`` were packed, of which ``certified_partitions`` met their own bound at once;
    ``gap_before`` and ``gap_after`` are the containers above the stage's bound before and after the exchanges.
    """
    items, rounds = packings(tokens, stages, exchanges, per_partition)
    rows = items.where("n_tokens > 0")
    # bins of the first round and of the last; full pieces are a container each
    first = rounds[0].groupBy("capacity", "part").agg(F.max("gap").alias("gap"), F.max("bin").alias("last")).groupBy("capacity").agg(F.count("*").alias("partitions"), F.count_if(F.col("gap") <= 0).alias("certified_partitions"), F.sum(F.col("last") + 1).alias("bins_before"))
    last = rounds[-1].select("capacity", "round", "home", "bin").distinct().groupBy("capacity").agg(F.count("*").alias("bins"))
    used = rows.groupBy("capacity").agg(F.count("*").alias("items"), F.count_if(F.col("n_tokens") == F.col("capacity")).alias("whole"), F.sum("n_tokens").alias("tokens"))
    histogram = rows.groupBy("capacity", "n_tokens").agg(F.count("*").alias("n"))

    def bound(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        return pd.DataFrame({"capacity": [capacity], "bound": [lower_bound(pdf["n_tokens"].to_numpy(), capacity, pdf["n"].to_numpy())]})

    bounds = histogram.groupBy("capacity").applyInPandas(bound, "capacity int, bound long")
    zero = dict.fromkeys(("partitions", "certified_partitions", "bins_before", "bins"), 0)
    joined = used.join(bounds, "capacity").join(first, "capacity", "left").join(last, "capacity", "left").fillna(zero, subset=list(zero)).withColumn("containers", F.col("whole") + F.col("bins"))
    padding = 1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))
    gap = F.col("containers") - F.col("bound")
    out = joined.join(F.broadcast(stage_sizes(stages)), "capacity")
    return out.select("stage", "capacity", "items", "containers", "bound", "tokens", F.round(padding, 6).alias("padding_share"), "partitions", "certified_partitions", (gap + F.col("bins_before") - F.col("bins")).alias("gap_before"), gap.alias("gap_after"))


def packing_check(tokens: DataFrame, stages: DataFrame) -> DataFrame:
    """``stage, capacity, texts, empty_texts, lost_texts, cut_texts, overlaps, overfull``: what a packing must keep to, counted.

    ``lost_texts``: texts whose pieces don't add up to their tokens; ``cut_texts``: texts cut
    though they fit; ``overlaps``: pieces that begin before the one in front ends; ``overfull``: pieces
    that end beyond the capacity. Each of the last four is 0 for a right packing.
    """
    tokens = settle(tokens, "pack-tokens")
    items, rounds = packings(tokens, stages)
    rows = settle(_placed(items, rounds[-1]), "pack-placed")
    sizes = stage_sizes(stages)
    texts = tokens.agg(F.count("*").alias("texts"), F.count_if(F.coalesce("n_tokens", F.lit(0)) == 0).alias("empty_texts"))
    per_text = rows.groupBy("capacity", "doc_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"))
    wrong = per_text.join(tokens, "doc_id", "right").groupBy("capacity").agg(F.count_if(~F.col("got").eqNullSafe(F.coalesce("n_tokens", F.lit(0)))).alias("lost_texts"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("cut_texts"))
    inside = Window.partitionBy("capacity", "container").orderBy("position", "doc_id")  # one container
    end = F.col("position") + F.col("n_tokens")
    placed = rows.where("container IS NOT NULL").select("capacity", "position", end.alias("end"), F.lag(end).over(inside).alias("before"))
    broken = placed.groupBy("capacity").agg(F.count_if(F.col("before") > F.col("position")).alias("overlaps"), F.count_if(F.col("end") > F.col("capacity")).alias("overfull"))
    counted = sizes.join(wrong, "capacity", "left").join(broken, "capacity", "left").fillna(0, subset=["lost_texts", "cut_texts", "overlaps", "overfull"])
    return counted.join(F.broadcast(texts)).select("stage", "capacity", "texts", "empty_texts", "lost_texts", "cut_texts", "overlaps", "overfull")
