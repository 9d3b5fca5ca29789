"""A reproducible sample that stays stable as data grows (problem 2).

A keyed Feistel network permutes a fixed domain of 2^62 identifiers; an identifier is
selected when its permuted value lies below ``rate x 2^62``. The decision depends on nothing
but the identifier and the seed: not on partitions, order, repeated rows or other rows, so
whatever was selected stays selected when rows arrive, and a higher rate selects a superset.
The permutation is a bijection, so distinct identifiers can't collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF = 31
MASK = (1 << HALF) - 1
ROUNDS = 8
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz_ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NUMBERED_LENGTH = 10  # 64^10 = 2^60


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """An odd 31-bit multiplier and a 31-bit addend per round, from a splitmix generator."""
    state, keys = seed & (2**64 - 1), []
    for _ in range(2 * rounds):
        state = (state + 0x9E3779B97F4A7C15) % 2**64
        z = state
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
        keys.append((z ^ (z >> 31)) & MASK)
    return [(a | 1, b) for a, b in zip(keys[::2], keys[1::2])]


def chain_number(chain_id: Column) -> Column:
    """The fixed numeric identifier of a chain id.

    Ids of up to 10 letters, digits and underscores map one to one into [1, 2^60); any other
    id (longer, other characters, empty) goes by its 60-bit SHA-256 prefix into the second
    quarter of the domain. Null stays null.
    """
    digits = F.transform(F.filter(F.split(chain_id, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c).cast("bigint"))
    number = F.aggregate(digits, F.lit(0).cast("bigint"), lambda a, d: a * 64 + d)
    hashed = F.conv(F.substring(F.sha2(chain_id, 256), 1, 15), 16, 10).cast("bigint") + F.lit(1 << 60)
    plain = chain_id.rlike(f"^[{ALPHABET}]{{1,{NUMBERED_LENGTH}}}$")
    return F.when(plain, number).when(chain_id.isNotNull(), hashed)


def permuted(number: Column, seed: int) -> Column:
    """The Feistel image of a number of [0, 2^62), in plain integer expressions."""
    left, right = F.shiftright(number, HALF).bitwiseAND(F.lit(MASK)), number.bitwiseAND(F.lit(MASK))
    state = F.struct(left.alias("l"), right.alias("r"))
    keys = F.array(*[F.struct(F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b")) for a, b in round_keys(seed)])

    def step(s: Column, k: Column) -> Column:
        mixed = F.shiftright(s["r"] * k["a"] + k["b"], 15)
        mixed = F.shiftright(mixed.bitwiseXOR(F.shiftright(mixed, 16)).bitwiseAND(F.lit(MASK)) * k["a"], 13)
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(mixed).bitwiseAND(F.lit(MASK)).alias("r"))

    return F.aggregate(keys, state, step, lambda s: F.shiftleft(s["l"], HALF).bitwiseOR(s["r"]))


def stable_sample(df: DataFrame, rate: float, seed: int = 20260820, key: str = "chain_id") -> DataFrame:
    """``chain_id, permuted``: the selected ids, each once.

    A null id is never selected. Rates at or below 0 select nothing, at or above 1 every id.
    """
    limit = int(max(0.0, min(1.0, rate)) * (1 << 62))
    ids = df.select(F.col(key).alias("chain_id")).where(F.col(key).isNotNull()).distinct()
    return ids.withColumn("permuted", permuted(chain_number(F.col("chain_id")), seed)).where(F.col("permuted") < F.lit(limit))


def sample_stability(df: DataFrame, rate: float, seed: int = 20260820, key: str = "chain_id", time: str = "cached_at") -> DataFrame:
    """One row: the sample of the rows up to the middle of the time span, and what became of it in the whole.

    ``kept`` of the ``early_selected`` ids are selected in the whole table too (all of them),
    ``added`` come from ids that arrived later. Rows without a time count as late.
    """
    middle = df.agg((F.min(time).cast("timestamp").cast("double") / 2 + F.max(time).cast("timestamp").cast("double") / 2).alias("m"))
    early = df.join(F.broadcast(middle)).where(F.col(time).cast("timestamp").cast("double") <= F.col("m"))
    part = stable_sample(early, rate, seed, key).select("chain_id", F.lit(True).alias("early"))
    both = stable_sample(df, rate, seed, key).select("chain_id", F.lit(True).alias("whole")).join(part, "chain_id", "full_outer")
    return both.agg(F.count("whole").alias("selected"), F.count("early").alias("early_selected"), F.count_if(F.col("early") & F.col("whole")).alias("kept"), F.count_if(F.col("whole") & F.col("early").isNull()).alias("added"))


def domain_check(df: DataFrame, key: str = "chain_id") -> DataFrame:
    """One row: distinct ``ids``, those ``numbered`` one to one, those ``hashed``, and how many of the latter share a number (``colliding``)."""
    number = chain_number(F.col("chain_id"))
    ids = df.select(F.col(key).alias("chain_id")).where(F.col(key).isNotNull()).distinct()
    per = ids.withColumn("x", number).groupBy("x").agg(F.count("*").alias("n"))
    hashed = F.col("x") >= F.lit(1 << 60)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("n").alias("ids"), total(F.when(~hashed, F.col("n"))).alias("numbered"), total(F.when(hashed, F.col("n"))).alias("hashed"), total(F.when(F.col("n") > 1, F.col("n"))).alias("colliding"))
