"""Global ordinals and running sums without a one-task window.

``Window.partitionBy(source)`` would sort a whole source, which may hold a third of all rows,
in one task. Here rows are range-partitioned by their full order, numbered inside each range
partition, and shifted by the totals of the earlier partitions (one row per partition and
group, so the broadcast is bounded by the number of tasks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.runtime import settle


RANGE_BYTES = 256 << 20


def range_tasks(df: DataFrame) -> int:
    """How many ranges to sort in: one per ``RANGE_BYTES`` that the plan reads, at least the session's shuffle partitions."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(s for s in sizes if s < 1 << 60)  # relations of unknown size claim about 2^63
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), 1 << 17))


def ranked(df: DataFrame, group: list[str], order: list[str], value: str | list[str] | None = None) -> DataFrame:
    """``df`` plus ``rn`` (1-based rank in the group) and running sums of ``value`` ahead of each row.

    One value gives the column ``before``, a list gives ``before_<name>`` for each. ``order``
    must be total within a group. Null groups are groups; null values add nothing.
    """
    names = [value] if isinstance(value, str) else value or []
    added = {v: "before" if isinstance(value, str) else f"before_{v}" for v in names}
    tasks = range_tasks(df)
    ranges = settle(df.repartitionByRange(tasks, *group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    amounts = {v: F.coalesce(F.col(v).cast("bigint"), F.lit(0)) for v in names}
    totals = ranges.groupBy(*group, "_range").agg(F.count("*").alias("_rows"), *[F.sum(a).alias(f"_sum_{v}") for v, a in amounts.items()])
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ["_rows", *[f"_sum_{v}" for v in names]]]
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_r"), *shifts)
    inside = Window.partitionBy("_range", *group).orderBy(*order)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = ranges.withColumn("_own", F.row_number().over(inside)).withColumns({f"_ahead_{v}": F.sum(a).over(ahead) for v, a in amounts.items()})
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = out.join(F.broadcast(offsets), same)
    sums = [(F.coalesce(f"_ahead_{v}", F.lit(0)) + F.col(f"_sum_{v}")).alias(name) for v, name in added.items()]
    return joined.select(*df.columns, (F.col("_own") + F.col("_rows")).alias("rn"), *sums)
