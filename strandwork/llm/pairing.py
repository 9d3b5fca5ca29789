"""All pairs inside groups of any size, without gathering a group in one task.

A group of more than ``PART`` members is cut by hash into parts, and each two parts (or a part
with itself) are a join key of their own: a hot group spreads over many tasks, each holding at
most about two parts. Nothing is capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 1024


def pairs_within(members: DataFrame, group: list[str], item: list[str], part: int = PART) -> DataFrame:
    """``a_<item>..., b_<item>...`` with a before b: every two different items of one group, once per group.

    ``members`` has the columns ``group`` and ``item``, no row twice. Items are ordered by their columns.
    """
    sizes = members.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / part).cast("int")
    placed = members.join(sizes, group).select(*group, *item, parts.alias("parts"), F.pmod(F.xxhash64(*item), parts.cast("bigint")).cast("int").alias("own"))
    left = placed.select(*group, F.col("own").alias("pa"), F.explode(F.sequence("own", F.col("parts") - 1)).alias("pb"), *[F.col(c).alias(f"a_{c}") for c in item])
    right = placed.select(*group, F.explode(F.sequence(F.lit(0), "own")).alias("pa"), F.col("own").alias("pb"), *[F.col(c).alias(f"b_{c}") for c in item])
    a, b = F.struct(*[F.col(f"a_{c}") for c in item]), F.struct(*[F.col(f"b_{c}") for c in item])
    met = left.join(right, [*group, "pa", "pb"]).where((F.col("pa") < F.col("pb")) | (a < b))
    swap = a > b
    first = [F.when(swap, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in item]
    second = [F.when(swap, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"b_{c}") for c in item]
    return met.select(*first, *second)
