"""Deterministic permutations, partitions, draws, exposure and resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.hashing import hash52, hex_rank, uniform
from strandwork.operators.ordering import ranked


def permutation(rows: DataFrame, seed: int, epoch: Column | int = 0) -> DataFrame:
    """``source, record_id, epoch, position`` (0-based): each source's order of an epoch.

    The order depends on seed, source, epoch and record only.
    """
    number = epoch if isinstance(epoch, Column) else F.lit(epoch)
    keyed = rows.where("source IS NOT NULL").select("source", "record_id", number.cast("int").alias("epoch"))
    keyed = keyed.withColumn("key", F.unhex(hex_rank(seed, F.col("source"), F.col("epoch"), F.col("record_id"))))
    return ranked(keyed, ["source", "epoch"], ["key", "record_id"]).select("source", "record_id", "epoch", (F.col("rn") - 1).alias("position"))


def rank_shares(order: DataFrame, world: int) -> DataFrame:
    """Strided ranks of a permutation: rows, first position and id sum per source and rank."""
    return order.groupBy("source", F.pmod("position", F.lit(world)).alias("rank")).agg(F.count("*").alias("rows"), F.min("position").alias("first_position"), F.sum("record_id").alias("id_sum"))


def mixture_draws(spark, weights: dict[str, float], draws: int, seed: int, batch: int, world: int) -> DataFrame:
    """``draw, source, batch, rank``: draw t takes the first source (by name) whose cumulative weight exceeds u(seed, t).

    A rank owns a contiguous slice of each batch, so the union over ranks doesn't depend on ``world``.
    """
    total, bound, pick = sum(weights.values()), 0.0, None
    u = uniform(seed, F.col("id"))
    names = sorted(w for w in weights if weights[w] > 0)
    for name in names[:-1]:
        bound += weights[name] / total
        pick = F.when(u < bound, name) if pick is None else pick.when(u < bound, name)
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(names[-1])
    each = batch // world
    return spark.range(draws).select(F.col("id").alias("draw"), pick.alias("source"), F.floor(F.col("id") / batch).alias("batch"), F.floor(F.pmod("id", F.lit(batch)) / each).alias("rank"))


def drawn_rows(draws: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """``draw, source, epoch, position, record_id``: the k-th draw of a source takes the k-th row of its permutations, epoch after epoch."""
    counted = ranked(draws.select("source", "draw"), ["source"], ["draw"])
    sizes = rows.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("size"))
    placed = counted.join(sizes, "source").select("draw", "source", F.floor((F.col("rn") - 1) / F.col("size")).cast("int").alias("epoch"), F.pmod(F.col("rn") - 1, F.col("size")).alias("position"))
    last = placed.groupBy("source").agg(F.max("epoch").alias("last"))
    epochs = rows.join(F.broadcast(last), "source").select("source", "record_id", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("epoch"))
    order = permutation(epochs, seed, F.col("epoch"))
    return placed.join(order, ["source", "epoch", "position"]).select("draw", "source", "epoch", "position", "record_id")


def exposure(global_rows: DataFrame) -> DataFrame:
    """The latest saved state per stage and source, as draws, unique and repeated records.

    ``prior`` draws come from the origin document. The latest is by time, then seed, epoch, cursor.
    """
    prior = F.coalesce(F.get_json_object("origin", "$.prior").cast("bigint"), F.lit(0))
    latest = F.max(F.struct("saved_at", "seed", "epoch", "epoch_cursor", "size", prior.alias("prior")))
    rows = global_rows.groupBy("stage", "source").agg(latest.alias("s")).select("stage", "source", "s.*")
    draws = F.col("prior") + F.col("epoch") * F.col("size") + F.col("epoch_cursor")
    return rows.select("stage", "source", "size", "epoch", "epoch_cursor", "prior", draws.alias("draws"), F.least(draws, F.col("size")).alias("unique_records"), F.greatest(draws - F.col("size"), F.lit(0)).alias("repeated_draws"), F.floor(draws / 4).alias("draws_per_rank"), F.pmod(draws, F.lit(4)).alias("extra_ranks"))


def state_consistency(global_rows: DataFrame) -> DataFrame:
    """Whether the saved states of a stage and source agree on policy, and how far they differ in size."""
    return global_rows.groupBy("stage", "source").agg(
        F.count("*").alias("states"),
        F.countDistinct("size").alias("sizes"),
        F.countDistinct("seed").alias("seeds"),
        (F.countDistinct("allow_resampling") <= 1).alias("policies_agree"),
        F.count_if(F.col("allow_resampling").isNull()).alias("policy_unknown"),
        F.count_if(F.col("epoch_cursor") > F.col("size")).alias("cursor_beyond_size"),
    )


def unseen(order: DataFrame, world: int, cursor: int) -> DataFrame:
    """Rows that ``world`` strided ranks, each ``cursor`` rows on, haven't consumed."""
    return order.where(F.floor(F.col("position") / world) >= cursor)


def expansion_queue(rows: DataFrame, cut: str, seed: int, new_seed: int, world: int, cursor: int) -> DataFrame:
    """Unseen earlier rows and rows ingested after ``cut``, in one new order.

    ``rows``: ``record_id, source, ingested_at``. Null times count as new.
    """
    old = F.coalesce(F.col("ingested_at") <= F.lit(cut).cast("timestamp_ntz"), F.lit(False))
    left = unseen(permutation(rows.where(old), seed), world, cursor).select("source", "record_id")
    queue = left.unionByName(rows.where(~old).where("source IS NOT NULL").select("source", "record_id"))
    return permutation(queue, new_seed).select("source", "record_id", "position")


def fragments_for_budget(fragments: DataFrame, seed: int, budget: int, chunk: int = 100) -> DataFrame:
    """Fragments in a seeded order until their rows reach the budget, in chunks."""
    rows = ranked(fragments.withColumn("key", hex_rank(seed, F.col("path"))), [], ["key", "path"], "records")
    return rows.where(F.col("before") < budget).select("path", "records", "rn", "before", F.floor((F.col("rn") - 1) / chunk).alias("chunk"))


def hashed_subset(ids: DataFrame, key: str, seed: int, limit: int, shards: int) -> DataFrame:
    """The first ``limit`` ids by seeded hash, dealt round-robin to ``shards`` workers.

    Every task keeps its own first ``limit`` ids, so that nothing but those is moved; the window
    runs over the ``limit`` chosen rows only.
    """
    keyed = ids.where(F.col(key).isNotNull()).select(key).distinct().withColumn("hash", hex_rank(seed, F.col(key)))
    chosen = keyed.orderBy("hash", key).limit(limit)
    placed = chosen.withColumn("rn", F.row_number().over(Window.orderBy("hash", key)).cast("bigint"))
    return placed.select(key, "rn", F.pmod(F.col("rn") - 1, F.lit(shards)).alias("shard"))


def crop_offset(digest: Column, size: Column, limit: int, seed: int) -> Column:
    """A crop start for longer sequences, by hash; 0 for the rest."""
    return F.when(size > limit, F.pmod(hash52(seed, digest), size - limit + 1)).otherwise(F.lit(0)).cast("bigint")


def source_seed(source: Column, seed: int) -> Column:
    """``seed`` plus the first eight bytes of the SHA-256 of a source's name."""
    return F.conv(F.substring(F.sha2(source, 256), 1, 16), 16, 10).cast("decimal(20,0)") + F.lit(seed).cast("decimal(20,0)")


def portable_check(ranks: DataFrame, drawn: DataFrame, sizes: DataFrame) -> DataFrame:
    """``source, ranks, counted, epoch, cursor, size, agrees``: counts of all ranks (``source, rank, n``) against the cursor left by the drawn rows.

    A state may move to another number of ranks only if the counts add up to the draws that the cursor stands for.
    """
    counted = ranks.groupBy("source").agg(F.count("*").alias("ranks"), F.sum("n").alias("counted"))
    last = drawn.groupBy("source").agg(F.max(F.struct("epoch", "position")).alias("s")).select("source", F.col("s.epoch").cast("bigint").alias("epoch"), (F.col("s.position") + 1).alias("cursor"))
    both = counted.join(last, "source", "full_outer").join(sizes, "source", "left")
    agrees = F.col("counted").eqNullSafe(F.col("epoch") * F.col("size") + F.col("cursor"))
    return both.select("source", "ranks", "counted", "epoch", "cursor", "size", agrees.alias("agrees"))


def restored(saved: DataFrame, contract: DataFrame) -> DataFrame:
    """Saved states beside the contract they must meet (``size, seed, allowed`` per stage and source).

    ``valid``: a first epoch, or resampling allowed, with the cursor inside the source. ``restored``: the state is there and nothing of the contract differs.
    """
    same = ["size", "seed", "allowed"]
    wanted = contract.select("stage", "source", *[F.col(c).alias(f"_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    valid = (F.col("epoch") >= 0) & ((F.col("epoch") == 0) | F.col("allowed")) & F.col("epoch_cursor").between(0, F.col("size"))
    return wanted.join(saved, ["stage", "source"], "left").select("stage", "source", *same[:2], "epoch", "epoch_cursor", "allowed", valid.alias("valid"), equal.alias("restored"))


def migration(rows: DataFrame, seed: int, new_seed: int, world: int, cursor: int) -> DataFrame:
    """``source, old_size, new_size, consumed, unseen, appended, queue, valid`` of an expansion; ``rows``: ``record_id, source, old``."""
    order = permutation(rows.where("old"), seed)
    used = order.where(F.floor(F.col("position") / world) < cursor).select("source", "record_id", F.lit(1).alias("used"))
    fresh = rows.where("NOT old AND source IS NOT NULL").select("source", "record_id")
    queue = permutation(unseen(order, world, cursor).select("source", "record_id").unionByName(fresh), new_seed).select("source", "record_id", F.lit(1).alias("queued"))
    each = rows.where("source IS NOT NULL").join(used, ["source", "record_id"], "left").join(queue, ["source", "record_id"], "left")
    once = F.coalesce("used", F.lit(0)) + F.coalesce("queued", F.lit(0)) == 1
    per = each.groupBy("source").agg(F.count_if("old").alias("old_size"), F.count("*").alias("new_size"), F.count("used").alias("consumed"), F.count("queued").alias("queue"), F.bool_and(once).alias("valid"))
    return per.select("source", "old_size", "new_size", "consumed", (F.col("old_size") - F.col("consumed")).alias("unseen"), (F.col("new_size") - F.col("old_size")).alias("appended"), "queue", "valid")
