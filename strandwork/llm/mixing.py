"""Mixing sources to target weights by hash-threshold histograms (problem 1).

Each stage wants ``budget`` residues, split over its sources in proportion to the non-null
weights. A source is passed whole as often as its share asks for and its policy allows; the
rest of the share is a *hash prefix*: the records whose 52-bit hash lies below a threshold.
Thresholds of all stages nest, because all use the same hash of the record.

The threshold is found without sorting records: residues are summed by source and hash
bucket, a cumulative sum over the buckets (never more than ``sources x 2^DIGIT``) finds the
one bucket in which the budget is crossed, and only the records of that bucket are split
into finer buckets, digit by digit, until the hash is used up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.hashing import hash52
from strandwork.runtime import settle

SEED = 20260820
DIGIT = 13
LEVELS = 4  # 4 x 13 = 52 bits


def stage_weights(stages: DataFrame) -> DataFrame:
    """``stage, source, weight, need``: a row per mixture entry with a non-null weight.

    ``need`` is the budget times the weight over the sum of the stage's non-null weights
    (null if that sum is 0 or the budget is null).
    """
    known = F.filter(F.map_entries("mixture"), lambda e: e["value"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, e: a + e["value"])
    entry = F.explode(known)
    return (
        stages.select(F.col("name").alias("stage"), "budget_residues", total.alias("total"), entry.alias("e"))
        .select("stage", F.col("e.key").alias("source"), F.col("e.value").alias("weight"), F.when(F.col("total") > 0, F.col("budget_residues") * F.col("e.value") / F.col("total")).alias("need"))
        .distinct()
    )


def pass_limits(global_rows: DataFrame) -> DataFrame:
    """``stage, source, passes``: ``max_epochs`` if resampling is allowed there, else one.

    Nulls in ``allow_resampling`` count for nothing; a missing or smaller ``max_epochs`` is one.
    """
    allowed = F.coalesce(F.bool_or("allow_resampling"), F.lit(False))
    return global_rows.groupBy("stage", "source").agg(F.when(allowed, F.greatest(F.lit(1), F.coalesce(F.max("max_epochs"), F.lit(1)))).otherwise(F.lit(1)).alias("passes"))


def train_records(released: DataFrame) -> DataFrame:
    """``record_id, source, length``: each train record once; a null length counts nothing."""
    return (
        released.where(F.col("split") == "train")
        .where(F.col("record_id").isNotNull() & F.col("source").isNotNull())
        .groupBy("record_id")
        .agg(F.min("source").alias("source"), F.max("length").cast("bigint").alias("length"))
        .withColumn("length", F.coalesce("length", F.lit(0)))
    )


def demands(stages: DataFrame, global_rows: DataFrame, supply: DataFrame) -> DataFrame:
    """One row per mixture entry: need, supply, allowed and full passes, and the rest to take from a hash prefix.

    A source without rows supplies 0. ``full`` whole passes plus ``rest`` residues of one
    more; ``rest`` is 0 once the allowed passes are spent.
    """
    passes = F.coalesce("passes", F.lit(1))
    residues = F.coalesce("residues", F.lit(0))
    wanted = stage_weights(stages).where(F.col("need").isNotNull())
    full = F.when(F.col("residues") > 0, F.least(F.col("passes").cast("bigint"), F.floor(F.col("need") / F.col("residues")))).otherwise(F.lit(0)).cast("bigint")
    return (
        wanted.join(pass_limits(global_rows), ["stage", "source"], "left")
        .join(supply, "source", "left")
        .select("stage", "source", "weight", "need", passes.alias("passes"), F.coalesce("records", F.lit(0)).alias("records"), residues.alias("residues"))
        .withColumn("supply", F.col("residues") * F.col("passes"))
        .withColumn("full", full)
        .withColumn("rest", F.when((F.col("full") < F.col("passes")) & (F.col("residues") > 0), F.col("need") - F.col("full") * F.col("residues")).otherwise(F.lit(0.0)))
    )


def shortfalls(stages: DataFrame, global_rows: DataFrame, released: DataFrame, seed: int = SEED) -> DataFrame:
    """``stage, source`` of the entries with a weight above 0 whose source can't fill its share.

    That is, where no bucket of the first histogram crosses the need in the last allowed pass.
    """
    histogram = _histogram(_hashed(train_records(released), seed).withColumn("prefix", F.lit(0).cast("bigint")), 0)
    histogram = histogram.withColumn("whole", F.sum("residues").over(Window.partitionBy("source")))
    wanted = stage_weights(stages).where("weight > 0 AND need > 0").join(pass_limits(global_rows), ["stage", "source"], "left").withColumn("passes", F.coalesce("passes", F.lit(1)))
    crossed = F.col("upto") + (F.col("passes") - 1) * F.col("whole") >= F.col("need")
    entries = wanted.join(histogram, "source", "left").groupBy("stage", "source", "weight", "need").agg(F.coalesce(F.bool_or(crossed), F.lit(False)).alias("filled"))
    return entries.where("NOT filled").select("stage", "source")


def _digit(level: int) -> Column:
    return F.shiftright("h", 52 - DIGIT * (level + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _hashed(records: DataFrame, seed: int) -> DataFrame:
    return records.select("source", "length", hash52(seed, F.col("record_id")).alias("h"))


def _histogram(hashed: DataFrame, level: int) -> DataFrame:
    """``source, prefix, bucket, residues, upto``: residues per hash bucket of a level, and the sum up to it."""
    histogram = hashed.groupBy("source", "prefix", _digit(level).alias("bucket")).agg(F.sum("length").alias("residues"))
    return histogram.withColumn("upto", F.sum("residues").over(Window.partitionBy("source", "prefix").orderBy("bucket")))


def prefix_thresholds(records: DataFrame, wants: DataFrame, seed: int = SEED) -> DataFrame:
    """``stage, source, threshold``: the largest hash of the smallest hash prefix whose residues reach ``rest``.

    ``records``: ``record_id, source, length``; ``wants``: ``stage, source, rest`` with
    ``rest > 0`` and at most what the source holds. Records with equal hashes enter together.
    """
    hashed = _hashed(records, seed)
    # state: what is still wanted inside the bucket named by the prefix found so far
    state = wants.select("stage", "source", "rest", F.lit(0).cast("bigint").alias("prefix"))
    for level in range(LEVELS):
        if level == 0:
            inside = hashed
        else:
            inside = hashed.withColumn("prefix", F.shiftright("h", 52 - DIGIT * level)).join(F.broadcast(state.select("source", "prefix").distinct()), ["source", "prefix"], "left_semi")
        histogram = _histogram(inside.withColumn("prefix", F.shiftright("h", 52 - DIGIT * level)), level)
        crossing = Window.partitionBy("stage", "source").orderBy("bucket")
        # sources x stages rows at most: the boundary buckets of this level
        state = settle(
            histogram.join(F.broadcast(state), ["source", "prefix"])
            .where(F.col("upto") >= F.col("rest"))
            .withColumn("rn", F.row_number().over(crossing))
            .where(F.col("rn") == 1)
            .select("stage", "source", (F.col("rest") - (F.col("upto") - F.col("residues"))).alias("rest"), (F.col("prefix") * (1 << DIGIT) + F.col("bucket")).alias("prefix")),
            f"mix-level{level}",
        )
    return state.select("stage", "source", F.col("prefix").alias("threshold"))


def mixture_draws(stages: DataFrame, global_rows: DataFrame, released: DataFrame, seed: int = SEED) -> DataFrame:
    """``stage, source, record_id, length, draws``: how often each train record is drawn (at least once).

    The plan tables (one row per stage and source) are broadcast: their size is that of the
    mixtures, whatever the corpus. Records are filtered by hash, never sorted.
    """
    records = settle(train_records(released), "mix-records")
    supply = records.groupBy("source").agg(F.count("*").alias("records"), F.sum("length").alias("residues"))
    plan = settle(demands(stages, global_rows, supply).where(F.col("residues") > 0), "mix-plan")
    cuts = prefix_thresholds(records, plan.where(F.col("rest") > 0), seed)
    plan = plan.join(cuts, ["stage", "source"], "left").select("stage", "source", "full", F.coalesce("threshold", F.lit(-1)).alias("threshold"))
    draws = F.col("full") + (F.col("h") <= F.col("threshold")).cast("bigint")
    return (
        records.withColumn("h", hash52(seed, F.col("record_id")))
        .join(F.broadcast(plan), "source")
        .select("stage", "source", "record_id", "length", draws.alias("draws"))
        .where(F.col("draws") > 0)
    )


def mixture_report(stages: DataFrame, global_rows: DataFrame, released: DataFrame, seed: int = SEED) -> DataFrame:
    """Draws per stage and source, and the share reached beside the target share.

    Entries that get nothing (weight 0, no rows) are kept with zeros.
    """
    drawn = mixture_draws(stages, global_rows, released, seed).groupBy("stage", "source").agg(F.count("*").alias("records_drawn"), F.sum("draws").alias("draws"), F.sum(F.col("draws") * F.col("length")).alias("residues_drawn"))
    wanted = stage_weights(stages)
    zero = {"records_drawn": 0, "draws": 0, "residues_drawn": 0}
    per_stage = Window.partitionBy("stage")
    share = reduce(lambda a, b: a / b, [F.col("residues_drawn"), F.nullif(F.sum("residues_drawn").over(per_stage), F.lit(0))])
    return (
        wanted.join(drawn, ["stage", "source"], "left")
        .fillna(zero, subset=list(zero))
        .withColumn("target_share", F.round(F.col("weight") / F.nullif(F.sum("weight").over(per_stage), F.lit(0.0)), 6))
        .withColumn("reached_share", F.round(share, 6))
        .select("stage", "source", "target_share", "records_drawn", "draws", "residues_drawn", "reached_share")
    )
