"""Shard packing, shard plans, budgets and coverage."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.operators.ordering import ranked
from strandwork.operators.sampling import exposure
from strandwork.runtime import settle

RECORD_BYTES = 44  # a store's index entry; a residue takes one byte


def manifest(rows: DataFrame) -> DataFrame:
    """Per shard file: counts, residues, digest range, and declared values that don't hold."""
    size = F.col("norm_length")
    return rows.groupBy("path").agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum(size), F.lit(0)).alias("residues"),
        F.min("digest").alias("least_digest"),
        F.max("digest").alias("greatest_digest"),
        F.count_if(F.col("length").isNull()).alias("no_length"),
        F.count_if(F.col("length") != size).alias("wrong_length"),
        F.count_if(F.col("sha").isNull()).alias("no_digest"),
        F.count_if(F.col("sha") != F.col("digest")).alias("wrong_digest"),
    )


BLOCK_SHARDS = 4
FANOUT = 8
_MAP = "source string, block long, key long, value long, complete boolean"


def _sorted(table: pa.Table, by: str, *columns: str) -> list[np.ndarray]:
    order = np.argsort(table.column(by).to_numpy(), kind="stable")
    return [table.column(c).to_numpy()[order] for c in columns]


def _walk(before: np.ndarray, upto: np.ndarray, at: np.ndarray, cap: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """From shard starts ``at`` to the last start in the block, and all starts on the way."""
    at, passed = at.copy(), [at.copy()]
    while True:
        following = np.maximum(at + 1, np.searchsorted(upto, before[at] + cap, side="right"))
        inside = following < len(before)
        if not inside.any():
            return at, passed
        at[inside] = following[inside]
        passed.append(at.copy())


def _exit(keys: np.ndarray, values: np.ndarray, start: np.ndarray, cap: int) -> np.ndarray:
    """Where the shard that is open behind a block begins, if the one open in front of it begins at ``start``."""
    at = np.searchsorted(keys, start + cap, side="right")
    return np.where(at < len(keys), values[np.minimum(at, len(keys) - 1)], start) if len(keys) else start


def _block_map(key: tuple, table: pa.Table, cap: int) -> pa.Table:
    before, upto = _sorted(table, "rn", "before", "upto")
    # the first new shard begins within a cap's residues: an earlier one would be over the cap by then
    first = np.flatnonzero(before <= before[0] + cap)
    last, _ = _walk(before, upto, first, cap)
    return _map_table(key, upto[first], before[last], len(first) == len(before))


def _map_table(key: tuple, keys: np.ndarray, values: np.ndarray, complete: bool) -> pa.Table:
    n = len(keys)
    columns = [pa.repeat(key[0], n), pa.repeat(key[1], n), pa.array(keys), pa.array(values), pa.repeat(pa.scalar(bool(complete)), n)]
    return pa.Table.from_arrays(columns, names=["source", "block", "key", "value", "complete"])


def _children(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    block, keys, values, complete = (table.column(c).to_numpy(zero_copy_only=False) for c in ("block", "key", "value", "complete"))
    order = np.lexsort((keys, block))
    block, keys, values, complete = block[order], keys[order], values[order], complete[order]
    begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    return [(int(block[a]), keys[a:b], values[a:b], bool(complete[a])) for a, b in zip(begin, np.append(begin[1:], len(block)))]


def _compose(key: tuple, table: pa.Table, cap: int) -> pa.Table:
    """The map of neighbouring blocks taken together."""
    keys, values, complete = np.zeros(0, np.int64), np.zeros(0, np.int64), True
    for _, k, v, whole in _children(table):
        values = _exit(k, v, values, cap)
        if complete:
            # only if no shard need have begun so far can the first one begin in this block
            keys, values = np.concatenate([keys, k]), np.concatenate([values, v])
        complete = complete and whole
    return _map_table((key[0], pa.scalar(key[1].as_py(), pa.int64())), keys, values, complete)


def _hand_down(key: tuple, maps: pa.Table, states: pa.Table, cap: int) -> pa.Table:
    """The start of the shard open in front of each child block."""
    at = np.array([states.column("start")[0].as_py()])
    blocks, starts = [], []
    for block, k, v, _ in _children(maps):
        blocks.append(block)
        starts.append(int(at[0]))
        at = _exit(k, v, at, cap)
    return pa.table({"source": pa.repeat(key[0], len(blocks)), "block": pa.array(blocks, pa.int64()), "start": pa.array(starts, pa.int64())})


def _starts(key: tuple, table: pa.Table, states: pa.Table, cap: int) -> pa.Table:
    rn, before, upto = _sorted(table, "rn", "rn", "before", "upto")
    first = np.searchsorted(upto, [states.column("start")[0].as_py() + cap], side="right")
    found = np.unique(np.concatenate(_walk(before, upto, first, cap)[1])) if first[0] < len(rn) else first[:0]
    return pa.table({"source": pa.repeat(key[0], len(found)), "rn": pa.array(rn[found], pa.int64())})


def shard_starts(r: DataFrame, cap: int, block_shards: int = BLOCK_SHARDS) -> DataFrame:
    """``source, rn`` of the rows that begin a shard; ``r``: ``source, rn, before, length``.

    Rows are cut into blocks of ``block_shards x cap`` residues. What a block does to the packing is a map from
    the start of the shard open in front of it to that of the one open behind it. It depends on nothing but the
    row that begins the first shard in the block, one of those in its first ``cap`` residues, so a map is that much smaller than
    its block. Maps of ``FANOUT`` neighbours are composed, level by level; the starts are then handed down the levels, and
    each block is walked once. Every row is read twice, and no task holds more than a block or ``FANOUT`` maps.
    """
    block = F.floor(F.col("before") / (cap * block_shards))
    rows = r.select("source", "rn", "before", (F.col("before") + F.col("length")).alias("upto"), block.alias("block"))
    maps = [settle(rows.groupBy("source", "block").applyInArrow(lambda k, t: _block_map(k, t, cap), _MAP), "shard-maps")]
    most = maps[0].agg(F.max("block")).first()[0] or 0
    while most:
        grouped = maps[-1].withColumn("parent", F.floor(F.col("block") / FANOUT)).groupBy("source", "parent")
        maps.append(settle(grouped.applyInArrow(lambda k, t: _compose(k, t, cap), _MAP), "shard-maps"))
        most //= FANOUT
    # in front of the first row no shard is open
    states = maps[-1].select("source").distinct().select("source", F.lit(0).cast("bigint").alias("block"), F.lit(-cap - 1).cast("bigint").alias("start"))
    for level in reversed(maps[:-1]):
        children = level.withColumn("parent", F.floor(F.col("block") / FANOUT)).groupBy("source", "parent")
        above = states.withColumnRenamed("block", "parent").groupBy("source", "parent")
        states = settle(children.cogroup(above).applyInArrow(lambda k, m, t: _hand_down(k, m, t, cap), "source string, block long, start long"), "shard-states")
    return rows.groupBy("source", "block").cogroup(states.groupBy("source", "block")).applyInArrow(lambda k, t, x: _starts(k, t, x, cap), "source string, rn long")


def pack_shards(rows: DataFrame, cap: int) -> DataFrame:
    """Sequential packing per source in digest order: a shard closes before it would cross ``cap`` residues.

    ``rows``: ``source, digest, length``, digests unique in a source. The packing is sequential, but not
    computed so (:func:`shard_starts`): no task ever holds a source. A row longer than ``cap`` is a shard of its own.
    """
    r = settle(ranked(rows.where("source IS NOT NULL AND length IS NOT NULL").select("source", "digest", F.col("length").cast("bigint").alias("length")), ["source"], ["digest"], "length"), "shard-rows")
    starts = settle(shard_starts(r, cap), "shard-starts")
    order = Window.partitionBy("source").orderBy("rn")  # shards, not rows
    totals = r.groupBy("source").agg(F.max("rn").alias("rows"), F.sum("length").alias("all"))
    begun = r.join(starts, ["source", "rn"], "left_semi").join(totals, "source")
    shards = begun.select(
        "source",
        (F.row_number().over(order) - 1).alias("shard"),
        (F.coalesce(F.lead("rn").over(order) - 1, F.col("rows"))).alias("last"),
        (F.coalesce(F.lead("rn").over(order) - 1, F.col("rows")) - F.col("rn") + 1).alias("records"),
        (F.coalesce(F.lead("before").over(order), F.col("all")) - F.col("before")).alias("residues"),
        F.col("digest").alias("least_digest"),
    )
    ends = r.select("source", F.col("rn").alias("last"), F.col("digest").alias("greatest_digest"))
    return shards.join(ends, ["source", "last"]).drop("last")


def shard_of(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``rows`` (``source, digest`` unique) with the ``shard`` that holds each, by counting shard starts along the digests."""
    starts = shards.select("source", F.col("least_digest").alias("digest"), F.lit(1).alias("begins"))
    placed = ranked(rows.join(starts, ["source", "digest"], "left"), ["source"], ["digest"], "begins")
    return placed.select(*rows.columns, (F.col("before") + F.coalesce("begins", F.lit(0)) - 1).alias("shard"))


def weight_column(weights: Mapping[str, float], source: str = "source") -> Column:
    """The weight of a source over the sum of weights; null for sources without one."""
    total = sum(weights.values())
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
    return F.try_element_at(F.create_map(*pairs), F.col(source)) / F.lit(float(total))


def plan_by_samples(shards: DataFrame, weights: Mapping[str, float], samples: int) -> DataFrame:
    """Per source the shortest shard prefix with ``ceil(samples x share)`` records; ``short`` marks sources that hold too few."""
    order = Window.partitionBy("source").orderBy("shard")
    share = weight_column(weights)
    rows = shards.withColumn("required", F.ceil(F.round(F.lit(samples) * share, 9))).where("required IS NOT NULL")
    rows = rows.withColumn("records_before", F.sum("records").over(order) - F.col("records")).withColumn("held", F.sum("records").over(Window.partitionBy("source")))
    return rows.where("records_before < required").select("source", "shard", "records", "required", "records_before", (F.col("held") < F.col("required")).alias("short"))


def plan_by_shards(shards: DataFrame, weights: Mapping[str, float], count: int) -> DataFrame:
    """``count`` shards, each next one from the source with the least records per weight so far.

    The greedy choice equals the first ``count`` shards by (records before / weight, source order).
    """
    order = Window.partitionBy("source").orderBy("shard")
    place = {s: i for i, s in enumerate(weights)}
    rank = F.element_at(F.create_map(*[F.lit(x) for k, v in place.items() for x in (k, v)]), F.col("source"))
    rows = shards.where(F.col("source").isin(list(place))).withColumn("covered", (F.sum("records").over(order) - F.col("records")) / weight_column(weights))
    first = rows.select("source", "shard", "records", F.round("covered", 6).alias("covered"), rank.alias("place")).orderBy("covered", "place", "shard").limit(count)
    return first.withColumn("pick", F.row_number().over(Window.orderBy("covered", "place", "shard"))).select("pick", "source", "shard", "records")


def storage(rows: DataFrame) -> DataFrame:
    """Store bytes per source and split: one per residue and ``RECORD_BYTES`` per record."""
    size = F.coalesce(F.sum("norm_length"), F.lit(0))
    return rows.groupBy("source", "split").agg(F.count("*").alias("records"), size.alias("residues"), (size + F.count("*") * RECORD_BYTES).alias("store_bytes"))


def coverage(stages: DataFrame, global_rows: DataFrame, supply: DataFrame, world: int = 4, headroom: float = 0.01) -> DataFrame:
    """Expected draws per stage and source against the records not yet seen.

    Draws: the stage's sequences (budget over context, upwards) times the share. ``required``
    adds the headroom and rounds up to whole rounds of the ranks. ``consumed`` are the unique
    records that the latest saved state has seen. ``sufficient``: enough unseen records, and
    at least one per rank; ``blocked``: insufficient, and resampling isn't allowed there.
    """
    known = F.filter(F.map_entries("mixture"), lambda e: e["value"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, e: a + e["value"])
    entries = stages.select(F.col("name").alias("stage"), "context_length", "budget_residues", total.alias("total"), F.explode(known).alias("e")).where("total > 0 AND context_length > 0")
    sequences = F.ceil(F.col("budget_residues") / F.col("context_length"))
    wanted = entries.select("stage", F.col("e.key").alias("source"), F.round(sequences * F.col("e.value") / F.col("total"), 6).alias("expected_draws")).distinct()
    policy = global_rows.groupBy("stage", "source").agg(F.coalesce(F.bool_or("allow_resampling"), F.lit(False)).alias("allowed"))
    seen = exposure(global_rows).select("stage", "source", "unique_records")
    joined = wanted.join(policy, ["stage", "source"], "left").join(seen, ["stage", "source"], "left").join(supply, "source", "left")
    available, allowed = F.coalesce("records", F.lit(0)), F.coalesce("allowed", F.lit(False))
    rows = joined.select("stage", "source", "expected_draws", (F.ceil(F.round(F.col("expected_draws") * (1 + headroom) / world, 6)) * world).alias("required"), available.alias("available"), F.least(F.coalesce("unique_records", F.lit(0)), available).alias("consumed"), allowed.alias("allowed"))
    enough = (F.col("available") - F.col("consumed") >= F.col("required")) & (F.col("available") >= world)
    return rows.withColumn("unused", F.col("available") - F.col("consumed")).withColumn("exposures", F.round(F.col("expected_draws") / F.nullif(F.col("available"), F.lit(0)), 6)).withColumn("sufficient", enough).withColumn("blocked", ~enough & ~F.col("allowed"))


def strict_check(covered: DataFrame) -> DataFrame:
    """Whether a stage's draws may begin: ``covered`` (as from :func:`coverage`) with ``wanted, unseen, exhausted, refused, granted``.

    All sources that may not be passed again are looked at before any draw: if one of them holds fewer unseen
    records than the stage draws from it, nothing is granted to the whole stage.
    """
    wanted = F.ceil(F.round("expected_draws", 6)).cast("bigint")
    rows = covered.select("stage", "source", wanted.alias("wanted"), F.col("unused").alias("unseen"), (~F.col("allowed")).alias("strict"))
    rows = rows.withColumn("exhausted", F.col("strict") & (F.col("wanted") > F.col("unseen")))
    stage = rows.groupBy("stage").agg(F.bool_or("exhausted").alias("refused"))
    return rows.join(stage, "stage").withColumn("granted", F.when(F.col("refused"), F.lit(0)).otherwise(F.col("wanted")).cast("bigint"))


POLICIES = ("error", "allow", "per_source")


def policy_outcomes(covered: DataFrame) -> DataFrame:
    """``stage, policy, sources, insufficient, status, refused`` for each resampling policy.

    Under ``per_source`` only sources that may not be repeated count as insufficient. ``allow`` reports, but never refuses.
    """
    each = covered.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES))))
    short = ~F.col("sufficient") & ((F.col("policy") != "per_source") | ~F.col("allowed"))
    per = each.groupBy("stage", "policy").agg(F.count("*").alias("sources"), F.count_if(short).alias("insufficient"))
    lacking = F.col("insufficient") > 0
    return per.select("stage", "policy", "sources", "insufficient", F.when(lacking, "insufficient").otherwise("passed").alias("status"), (lacking & (F.col("policy") != "allow")).alias("refused"))


def require_coverage(covered: DataFrame, policy: str, headroom: float = 0.01) -> DataFrame:
    """``covered`` itself, or an error that names the stages and sources which fall short under ``policy``."""
    if policy not in POLICIES or not 0 <= headroom < float("inf"):
        raise ValueError("policy must be one of " + ", ".join(POLICIES) + " and headroom finite and not negative")
    short = covered.where("NOT sufficient" + (" AND NOT allowed" if policy == "per_source" else ""))
    if policy != "allow":
        # one row per stage and source of the plan at most
        lacking = [f"{r['stage']}/{r['source']}: {r['unused']} unused, {r['required']} required" for r in short.orderBy("stage", "source").collect()]
        if lacking:
            raise ValueError("too few records: " + "; ".join(lacking))
    return covered


def reusable_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """``source, old_shards, new_shards, action`` of two plans (``source, shard, records``): unchanged sources are reused, the others written."""
    a = old.select("source", "shard", F.col("records").alias("a"))
    b = new.select("source", "shard", F.col("records").alias("b"))
    both = a.join(b, ["source", "shard"], "full_outer")
    same = F.bool_and(F.col("a").eqNullSafe(F.col("b")))
    return both.groupBy("source").agg(F.count("a").alias("old_shards"), F.count("b").alias("new_shards"), F.when(same, "reuse").otherwise("write").alias("action"))


def shard_rules(manifest: DataFrame) -> DataFrame:
    """``rule, shards, violations`` of a manifest: ``source, split, path, records, residues, least_digest, greatest_digest``.

    Paths are unique, relative and named after source and split; shards hold records and residues; digests are
    well formed, and rise strictly from shard to shard of a source and split; every source has both splits.
    """
    hexed = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    order = Window.partitionBy("source", "split").orderBy("path")  # shards, not rows
    rows = manifest.withColumn("previous", F.lag("greatest_digest").over(order)).withColumn("times", F.count("*").over(Window.partitionBy("path")))
    rows = rows.join(manifest.groupBy("source").agg(F.countDistinct("split").alias("splits")), "source")
    checks = {
        "path_unique": F.col("times") == 1,
        "path_relative": ~F.col("path").startswith("/") & ~F.array_contains(F.split("path", "/"), ".."),
        "path_named": F.col("path").startswith(F.concat_ws("/", "source", "split", F.lit(""))),
        "holds_records": (F.col("records") > 0) & (F.col("residues") > 0),
        "digests_formed": hexed("least_digest") & hexed("greatest_digest"),
        "digests_rise": (F.col("least_digest") <= F.col("greatest_digest")) & (F.col("previous").isNull() | (F.col("least_digest") > F.col("previous"))),
        "both_splits": F.col("splits") == 2,
    }
    counts = rows.agg(F.count("*").alias("shards"), *[F.count_if(~F.coalesce(holds, F.lit(False))).alias(name) for name, holds in checks.items()])
    entries = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in checks]))
    return counts.select("shards", entries.alias("e")).select("e.rule", "shards", "e.violations")
