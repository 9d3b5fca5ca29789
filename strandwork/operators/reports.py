"""Batches, run reports, schedules and decision rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.ordering import ranked


def balanced_groups(lengths: list[int], world: int) -> list[list[int]]:
    """Deal a batch to ``world`` ranks of equal count by longest-first greedy load.

    Longest first (ties by place), each to the least loaded rank with room (ties: fewer
    members, then the lower rank). Contiguous blocks are kept if their greatest load is less.
    """
    room = len(lengths) // world
    groups: list[list[int]] = [[] for _ in range(world)]
    load = [0] * world
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        rank = min((r for r in range(world) if len(groups[r]) < room), key=lambda r: (load[r], len(groups[r]), r))
        groups[rank].append(i)
        load[rank] += lengths[i]
    start = [r * room for r in range(world)]
    untouched = max((sum(lengths[s : s + room]) for s in start), default=0)
    return groups if max(load) <= untouched else [list(range(s, s + room)) for s in start]


def balance_batches(batches: DataFrame, world: int) -> DataFrame:
    """``source, batch, item, length, rank``: each batch of a source (a bounded group) dealt to ranks; ``batches``: ``source, batch, item, length``.

    Batches whose size ``world`` doesn't divide keep their overhang on the last rank, which then takes the lightest
    group; where that would be worse than contiguous blocks, the blocks stay.
    """

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item").reset_index(drop=True)
        lengths, room = pdf["length"].tolist(), len(pdf) // world
        even = room * world
        blocks = [list(range(r * room, (r + 1) * room)) for r in range(world)]
        load = lambda members: sum(lengths[i] for i in members)
        groups = balanced_groups(lengths[:even], world) if even else blocks
        if even < len(pdf):
            groups = sorted(groups, key=load, reverse=True)
            over = load(range(even, len(pdf)))
            most = lambda parts: max([*map(load, parts[:-1]), load(parts[-1]) + over])
            groups = groups if most(groups) <= most(blocks) else blocks
        rank = [world - 1] * len(pdf)
        for r, members in enumerate(groups):
            for i in members:
                rank[i] = r
        return pdf.assign(rank=rank)

    return batches.groupBy("source", "batch").applyInPandas(deal, "source string, batch long, item long, length long, rank int")


def length_batches(rows: DataFrame, key: str, size: int, workers: int) -> DataFrame:
    """Batches of similar length: rows ordered by length and id, ``size`` to a batch, batches round-robin to workers."""
    order = ranked(rows.where("length IS NOT NULL"), [], ["length", key])
    batch = F.floor((F.col("rn") - 1) / size)
    return order.select(key, "length", batch.alias("batch"), F.pmod(batch, F.lit(workers)).alias("worker"))


def mean_sd(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean and sample SD (null for one value) per group; null values are left out."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("sd"))


def coverage_check(parts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Whether worker outputs cover the expected ids exactly once."""
    per = parts.groupBy(key).agg(F.count("*").alias("times"))
    both = expected.select(key).distinct().withColumn("wanted", F.lit(True)).join(per, key, "full_outer")
    return both.agg(F.count_if(F.col("wanted") & F.col("times").isNull()).alias("missing"), F.count_if(F.col("times") > 1).alias("repeated"), F.count_if(F.col("wanted").isNull()).alias("unknown"), F.count_if(F.col("wanted") & (F.col("times") == 1)).alias("once"))


def strict_merge(parts: DataFrame, population: DataFrame, key: str, workers: int) -> DataFrame:
    """``expected, once, missing, repeated, unknown, misplaced`` of worker outputs: ``key, position, worker``.

    ``population``: ``key, position``. Units are dealt by position, so unit ``p`` must come from worker ``p mod workers``
    (misplaced otherwise). All but ``once`` must be 0, and ``once`` all that is expected, for a merge to stand.
    """
    moved = F.col("worker") != F.pmod("position", F.lit(workers))
    per = parts.groupBy(key).agg(F.count("*").alias("times"), F.bool_or(moved).alias("moved"))
    both = population.select(key, F.lit(True).alias("wanted")).join(per, key, "full_outer")
    held = F.col("wanted") & F.col("times").isNotNull()
    return both.agg(
        F.count("wanted").alias("expected"),
        F.count_if(held & (F.col("times") == 1)).alias("once"),
        F.count_if(F.col("wanted") & F.col("times").isNull()).alias("missing"),
        F.count_if(held & (F.col("times") > 1)).alias("repeated"),
        F.count_if(F.col("wanted").isNull()).alias("unknown"),
        F.count_if(held & F.col("moved")).alias("misplaced"),
    )


def reward_gate(trials: list[tuple[int, float, float, float]]) -> list[tuple[int, str, float, float]]:
    """Fold trials ``(trial, first, mean, sd)`` in order; the incumbent starts as the first one.

    Discard early if the first score isn't above the incumbent's mean; keep if the mean gains
    more than the greater of both SDs.
    """
    out = []
    mean = sd = None
    for trial, first, m, s in sorted(trials):
        if mean is None:
            decision, mean, sd = "baseline", m, s
        elif first <= mean:
            decision = "discard_early"
        elif m - mean > max(s, sd):
            decision, mean, sd = "keep", m, s
        else:
            decision = "discard"
        out.append((trial, decision, round(mean, 6), round(sd, 6)))
    return out


def gate_trials(trials: DataFrame) -> DataFrame:
    """:func:`reward_gate` over a table of trials (one row per search trial, folded in one small group)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(reward_gate(list(pdf[["trial", "first", "mean", "sd"]].itertuples(index=False, name=None))), columns=["trial", "decision", "incumbent_mean", "incumbent_sd"])

    return trials.groupBy(F.lit(0).alias("g")).applyInPandas(fold, "trial long, decision string, incumbent_mean double, incumbent_sd double")


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def stage_at(progress: Column, first_fraction: float) -> tuple[Column, Column]:
    """Stage name and progress inside it, for a two-stage run."""
    p = clamp(progress)
    early = p < first_fraction
    return F.when(early, "stage1").otherwise("stage2"), F.when(early, p / first_fraction).otherwise((p - first_fraction) / (1 - first_fraction))


def rate_multiplier(step: Column, warmup: int, stage: Column, progress: Column, least: float = 0.1, cooldown: float = 0.0) -> Column:
    """Warm-up ramp, constant first stage (with an optional cooldown at its end), linear decay in the second."""
    decay = lambda x: 1 - clamp(x) * (1 - least)
    first = decay((progress - (1 - cooldown)) / cooldown) if cooldown else F.lit(1.0)
    return F.when(step <= warmup, F.greatest(step, F.lit(1)) / max(warmup, 1)).when(stage == "stage1", first).otherwise(decay(progress))


def parameter_count(width: Column, layers: Column, vocabulary: Column, rms: Column, routing: Column, tied: Column) -> Column:
    """Closed-form parameter count of an encoder with gated feed-forward blocks."""
    hidden = F.floor((F.floor(width * 8 / 3 * 1.0) + 255) / 256) * 256
    block = F.when(rms, 0).otherwise(6 * width) + 4 * width * width + 3 * hidden * width
    head = width * width + width + 2 * width + width * vocabulary + vocabulary
    table = vocabulary * width
    return (table + layers * block + F.when(rms, 0).otherwise(width) + head + F.when(routing, 2 * layers).otherwise(0) - F.when(tied, table).otherwise(0)).cast("bigint")


def stop_reason(tokens: Column, max_tokens: int | None, step: Column, max_steps: int | None, seconds: Column, wall: float, deadline: Column | None = None) -> Column:
    """The first reason that holds: tokens, steps, deadline, wall time; else null."""
    rules = []
    if max_tokens is not None:
        rules.append(F.when(tokens >= max_tokens, "max_model_tokens"))
    if max_steps is not None:
        rules.append(F.when(step >= max_steps, "max_steps"))
    if deadline is not None:
        rules.append(F.when(deadline, "allocation_deadline"))
    return F.coalesce(*rules, F.when(seconds >= wall, "walltime"))


def ordered_equal(left: DataFrame, right: DataFrame, ordinal: str, value: str) -> DataFrame:
    """Rows in which two ordered lists differ, of how many: full outer join on the ordinal."""
    a = left.select(ordinal, F.col(value).alias("a"), F.lit(1).alias("in_a"))
    b = right.select(ordinal, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, ordinal, "full_outer")
    return both.agg(F.count("*").alias("rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"), F.count_if(F.col("in_a").isNull()).alias("only_right"), F.count_if(F.col("in_b").isNull()).alias("only_left"))


def previous(value: str, group: list[str], order: str) -> Column:
    """The value of the row before, in a bounded group."""
    return F.lag(value).over(Window.partitionBy(*group).orderBy(order))


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How two sets of keys differ, both ways; null keys are no members."""
    a = left.where(F.col(key).isNotNull()).select(key).distinct().withColumn("l", F.lit(1))
    b = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("r", F.lit(1))
    only_left, only_right = F.count_if(F.col("r").isNull()), F.count_if(F.col("l").isNull())
    both = a.join(b, key, "full_outer")
    return both.agg(F.count("l").alias("left_keys"), F.count("r").alias("right_keys"), only_left.alias("only_left"), only_right.alias("only_right"), (only_left + only_right == 0).alias("equal"), (only_left == 0).alias("right_holds_left"), (only_right == 0).alias("left_holds_right"))


DIGEST_CHUNK = 1024


def ordered_digest(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """``group, units, digest``: an order-sensitive digest of any number of rows, by two levels of ``DIGEST_CHUNK`` texts each, and one above."""
    level = ranked(rows.select(group, order, text), [group], [order]).select(group, (F.col("rn") - 1).alias("n"), F.col(text).alias("h"), F.lit(1).alias("units"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "h"))), lambda x: x["h"]), "\n"), 256)
    for _ in range(2):
        level = level.groupBy(group, F.floor(F.col("n") / DIGEST_CHUNK).alias("m")).agg(joined.alias("h"), F.sum("units").alias("units")).withColumnRenamed("m", "n")
    return level.groupBy(group).agg(F.sum("units").alias("units"), joined.alias("digest"))


# Units and attempts of the two evaluation profiles.
PROFILES = [("search", "contact", "chain", 8192, 1), ("search", "chain_loss", "chain", 8192, 1), ("scaleup", "contact", "chain", 26062, 5), ("scaleup", "chain_loss", "chain", 26062, 5), ("scaleup", "record_loss", "record", 12288, 5)]


def profile_tasks(chains: DataFrame, held: DataFrame) -> DataFrame:
    """``profile, kind, units, attempts, tasks`` for the chains and records there are (one row each: ``chain``, ``record``)."""
    counts = chains.select(F.lit("chain").alias("of"), F.col("chain").alias("n")).unionByName(held.select(F.lit("record").alias("of"), F.col("record").alias("n")))
    wanted = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("profile", "kind", "what", "most", "attempts"), p)]) for p in PROFILES])
    rows = counts.select("of", "n", F.explode(wanted).alias("p")).where("p.what = of").select("p.profile", "p.kind", F.least(F.col("n"), F.col("p.most").cast("bigint")).alias("units"), "p.attempts")
    return rows.withColumn("tasks", F.col("units") * F.col("attempts"))


def step_split(stages: DataFrame, world: int, fraction: float = 2 / 3) -> DataFrame:
    """``stage, global_batch, steps, first_steps, second_steps, consumed, first_left, second_left`` of each stage with a positive layout."""
    rows = stages.where("context_length > 0 AND micro_batch_size > 0 AND gradient_accumulation > 0")
    batch = F.col("micro_batch_size") * F.col("gradient_accumulation") * world
    sized = rows.select(F.col("name").alias("stage"), batch.alias("global_batch"), F.ceil(F.col("budget_residues") / (F.col("context_length").cast("bigint") * batch)).alias("steps"))
    first = F.least("steps", F.ceil(F.round(F.col("steps") * F.lit(fraction), 9)))
    split = sized.withColumn("first_steps", first).withColumn("second_steps", F.col("steps") - first).withColumn("consumed", F.floor(F.col("steps") / 2))
    none = F.lit(0).cast("bigint")
    return split.withColumn("first_left", F.greatest(none, F.col("first_steps") - F.col("consumed"))).withColumn("second_left", F.greatest(none, F.col("steps") - F.greatest("first_steps", "consumed")))


def transferred(width: Column, layers: Column, rate: float = 6e-4, decay: float = 0.01, base_width: float = 512, base_layers: float = 16) -> tuple[Column, Column]:
    """Learning rate and weight decay carried from a base width and depth to another."""
    moved = F.lit(rate) * base_width / width * F.sqrt(F.lit(float(base_layers)) / layers)
    return moved, F.lit(rate * decay) / moved


def continuation(step: Column, total: int, start: int) -> Column:
    """Progress of a continuation that began at ``start``, towards ``total``; null ahead of it."""
    if not 0 <= start < total:
        raise ValueError("a continuation begins ahead of its end")
    return F.when(step >= start, (step - start) / F.lit(float(total - start)))


def rank_loads(dealt: DataFrame, size: int, world: int) -> DataFrame:
    """``source, batch, items, tokens, max_before, max_after, moved, even`` of :func:`balance_batches` rows in batches of ``size``.

    Before: ranks hold contiguous blocks of equal count, and the last one the overhang. ``even``: counts per rank are unchanged.
    """
    place = F.pmod("item", F.lit(size))
    n = dealt.groupBy("source", "batch").agg(F.count("*").alias("items"))
    room = F.floor(F.col("items") / world)
    block = F.when((room == 0) | (place >= room * world), F.lit(world - 1)).otherwise(F.floor(place / F.greatest(room, F.lit(1)))).cast("int")
    rows = dealt.join(n, ["source", "batch"]).withColumn("block", block)
    load = lambda r, at: F.sum(F.when(F.col(at) == r, F.col("length")).otherwise(F.lit(0)))
    held = lambda r, at: F.count_if(F.col(at) == r)
    ranks = range(world)
    even = F.lit(True)
    for r in ranks:
        even = even & (held(r, "block") == held(r, "rank"))
    return rows.groupBy("source", "batch").agg(F.count("*").alias("items"), F.sum("length").alias("tokens"), F.greatest(*[load(r, "block") for r in ranks]).alias("max_before"), F.greatest(*[load(r, "rank") for r in ranks]).alias("max_after"), F.count_if(F.col("block") != F.col("rank")).alias("moved"), even.alias("even"))
