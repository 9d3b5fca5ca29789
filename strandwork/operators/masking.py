"""Masked positions, token statistics and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.hashing import TWO_52, hash52
from strandwork.functions.sequence import CANONICAL, MASK, RESIDUES, VOCABULARY, token_ids
from strandwork.operators.sampling import crop_offset

RATE = 0.15
LIMIT = 510
IGNORED = -100  # fixed: the label of positions that carry no loss


def cropped(rows: DataFrame, limit: int = LIMIT, seed: int = 20260821) -> DataFrame:
    """``rows`` with ``crop``: at most ``limit`` residues from a hashed offset. Null sequences are left out."""
    start = crop_offset(F.col("digest"), F.length("norm"), limit, seed)
    return rows.where("norm IS NOT NULL").withColumn("crop", F.substring(F.col("norm"), (start + 1).cast("int"), F.lit(limit)))


def eligible_positions(crop: Column) -> Column:
    """1-based positions of canonical residues."""
    every = F.when(F.length(crop) > 0, F.sequence(F.lit(1), F.length(crop))).otherwise(F.array().cast("array<int>"))
    return F.filter(every, lambda p: F.instr(F.lit(CANONICAL), F.substring(crop, p, F.lit(1))) > 0)


def masked_positions(positions: Column, digest: Column, seed: int, rate: float = RATE) -> Column:
    """Positions whose hash lies below the rate; if there are none, the one with the least hash.

    Stays inside the row: no explode, no shuffle. No eligible position gives an empty array.
    """
    ranked = F.transform(positions, lambda p: F.struct(hash52(seed, digest, p).alias("u"), p.alias("p")))
    below = F.filter(ranked, lambda x: x["u"] < int(rate * TWO_52))
    least = F.when(F.size(ranked) > 0, F.array(F.array_min(ranked))).otherwise(F.slice(ranked, 1, 0))
    return F.transform(F.when(F.size(below) > 0, below).otherwise(least), lambda x: x["p"])


def masked(rows: DataFrame, seed: int, limit: int = LIMIT) -> DataFrame:
    """``rows`` with ``crop``, ``eligible`` (positions) and ``targets`` (masked positions)."""
    at = cropped(rows, limit).withColumn("eligible", eligible_positions(F.col("crop")))
    return at.withColumn("targets", masked_positions(F.col("eligible"), F.col("digest"), seed))


def corrupted(rows: DataFrame) -> DataFrame:
    """:func:`masked` rows with ``tokens`` (targets replaced by the mask token) and ``labels`` (the hidden ids, ``IGNORED`` elsewhere)."""
    at = rows.withColumn("ids", token_ids(F.col("crop")))
    hidden = lambda i: F.array_contains("targets", i + 1)
    return at.withColumn("tokens", F.transform("ids", lambda t, i: F.when(hidden(i), F.lit(MASK)).otherwise(t))).withColumn("labels", F.transform("ids", lambda t, i: F.when(hidden(i), t).otherwise(F.lit(IGNORED)))).drop("ids")


def residue_counts(rows: DataFrame) -> list[Column]:
    """One sum per residue, by length differences (no explode)."""
    return [F.coalesce(F.sum(F.length("norm") - F.length(F.replace(F.col("norm"), F.lit(c)))), F.lit(0)).alias(c) for c in RESIDUES]


def token_histogram(rows: DataFrame) -> DataFrame:
    """``source, token_id, n`` over the residues of all rows."""
    wide = rows.groupBy("source").agg(*residue_counts(rows))
    entries = F.explode(F.array(*[F.struct(F.lit(VOCABULARY.index(c)).alias("token_id"), F.col(c).alias("n")) for c in RESIDUES]))
    return wide.select("source", entries.alias("e")).select("source", "e.token_id", "e.n").where("n > 0")


def unigram_losses(train: DataFrame) -> dict[str, float]:
    """Negative log frequency per residue (add-one), from all train rows; the vocabulary bounds it."""
    import math

    counts = train.agg(*residue_counts(train)).first().asDict()
    total = sum(counts.values()) + len(RESIDUES)
    return {c: -math.log((n + 1) / total) for c, n in counts.items()}


def unit_losses(rows: DataFrame, losses: dict[str, float]) -> DataFrame:
    """``loss`` (mean over the targets, 0 without targets) and ``n_targets`` per masked row."""
    table = F.create_map(*[F.lit(x) for c, v in losses.items() for x in (c, v)])
    total = F.aggregate("targets", F.lit(0.0), lambda a, p: a + F.element_at(table, F.substring(F.col("crop"), p, F.lit(1))))
    n = F.size("targets")
    return rows.withColumn("n_targets", n).withColumn("loss", total / F.greatest(n, F.lit(1)))


def loss_report(units: DataFrame, by: list[str]) -> DataFrame:
    """Macro mean, target-weighted and root-weighted losses; units without targets stay in the count."""
    m, loss = F.col("n_targets"), F.col("loss")
    return units.groupBy(*by).agg(
        F.count("*").alias("units"),
        F.count_if(m == 0).alias("zero_target_units"),
        F.sum(m).alias("targets"),
        F.round(F.avg(loss), 6).alias("macro_loss"),
        F.round(F.sum(m * loss) / F.greatest(F.sum(m), F.lit(1)), 6).alias("target_loss"),
        F.round(F.sum(F.sqrt(m) * loss) / F.greatest(F.sum(F.sqrt(m)), F.lit(1.0)), 6).alias("root_loss"),
    )
