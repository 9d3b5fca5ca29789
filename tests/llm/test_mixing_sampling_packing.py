import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwork.llm import mixing, packing, sampling

STAGES = "name string, context_length int, mixture map<string, double>, budget_residues long"
GLOBAL = "stage string, source string, allow_resampling boolean, max_epochs int"
REL = "record_id long, source string, split string, length int"


def mixture_tables(spark):
    stages = spark.createDataFrame([("s", 8, {"a": 1.0, "b": 1.0, "c": 2.0, "d": None, "e": 0.0}, 400), ("t", 8, {"a": 3.0}, 1000), ("n", 8, {"a": None}, 5), ("z", 8, None, 5)], STAGES)
    states = spark.createDataFrame([("s", "b", None, 3), ("s", "b", True, 3), ("s", "c", False, 9), ("t", "a", True, None)], GLOBAL)
    rows = [(i, "a", "train", 10) for i in range(20)] + [(100 + i, "b", "train", 5) for i in range(10)] + [(i, "a", "train", 10) for i in range(5)]
    rows += [(300, "a", "validation", 9), (301, None, "train", 9), (302, "b", "train", None)]
    return stages, states, spark.createDataFrame(rows, REL).withColumn("stage", F.lit("clash"))


def test_shortfalls(spark):
    # s: needs 100, 100, 200, 0; a supplies 200, b 3 x 50, c nothing; t needs 1000 of a once
    assert sorted(map(tuple, mixing.shortfalls(*mixture_tables(spark)).collect())) == [("s", "c"), ("t", "a")]


def test_draws_and_report(spark):
    tables = mixture_tables(spark)
    rows = mixing.mixture_draws(*tables).collect()
    per = {}
    for r in rows:
        per.setdefault((r["stage"], r["source"]), []).append((r["record_id"], r["draws"]))
    assert len(per["s", "a"]) == 10 and all(n == 1 for _, n in per["s", "a"])
    assert {i for i, _ in per["s", "a"]} <= {i for i, _ in per["t", "a"]}
    assert sum(n for i, n in per["s", "b"] if i != 302) == 20 and max(n for _, n in per["s", "b"]) <= 3
    assert len(per["t", "a"]) == 20
    report = {(r["stage"], r["source"]): r for r in mixing.mixture_report(*tables).collect()}
    assert report["s", "a"]["residues_drawn"] == 100 and report["s", "c"]["draws"] == 0 and report["s", "e"]["target_share"] == 0
    assert ("s", "d") not in report and report["s", "b"]["reached_share"] == 0.5


def test_mixture_of_empty_tables(spark):
    stages, states, rows = mixture_tables(spark)
    assert mixing.mixture_draws(stages, states, rows.limit(0)).count() == 0
    assert mixing.shortfalls(stages.limit(0), states, rows).count() == 0
    assert {tuple(r) for r in mixing.shortfalls(stages, states.limit(0), rows.limit(0)).collect()} == {("s", "a"), ("s", "b"), ("s", "c"), ("t", "a")}


def test_sample_is_stable(spark):
    ids = [f"k{i:06d}_A" for i in range(3000)] + ["long-identifier-of-another-kind", "é", "", None]
    df = spark.createDataFrame([(i,) for i in ids], "chain_id string").withColumn("permuted", F.lit(0))
    early = {r["chain_id"] for r in sampling.stable_sample(df.limit(1500), 0.2).collect()}
    whole = {r["chain_id"] for r in sampling.stable_sample(df.union(df).repartition(7), 0.2).collect()}
    more = {r["chain_id"] for r in sampling.stable_sample(df, 0.4).collect()}
    assert early <= whole <= more and abs(len(whole) / 3000 - 0.2) < 0.03
    assert sampling.stable_sample(df, 0).count() == 0 and sampling.stable_sample(df, 1.5).count() == 3003
    assert sampling.stable_sample(df.limit(0), 0.5).count() == 0


def test_feistel_is_a_permutation(spark):
    rows = spark.range(20000).select("id", sampling.permuted(F.col("id"), 7).alias("p"), sampling.permuted(F.col("id") + (1 << 61), 7).alias("q"))
    got = rows.agg(F.countDistinct("p"), F.countDistinct("q"), F.min("p"), F.max("q")).first()
    assert got[0] == got[1] == 20000 and got[2] >= 0 and got[3] < 1 << 62


def test_chain_numbers_are_injective(spark):
    ids = ["a", "A", "0", "00", "_", "k03d_A", "k03d_a", "zzzzzzzzzz", "0000000000"]
    numbers = [r["n"] for r in spark.createDataFrame([(i,) for i in ids], "c string").select(sampling.chain_number(F.col("c")).alias("n")).collect()]
    assert len(set(numbers)) == len(ids) and all(0 < n <= 1 << 60 for n in numbers)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_best_fit_and_bound(sizes):
    capacity = 30
    sizes = np.array(sizes, dtype=np.int64)
    place, offset, used = packing.best_fit_decreasing(sizes, capacity)
    fill = {}
    for s, b, o in sorted(zip(sizes.tolist(), place.tolist(), offset.tolist()), key=lambda x: (x[1], x[2])):
        assert fill.get(b, 0) == o
        fill[b] = o + s
    assert len(fill) == used and all(v <= capacity for v in fill.values())
    bound = packing.lower_bound(sizes, capacity)
    assert -(-int(sizes.sum()) // capacity) <= bound <= used


def test_bound_sees_large_items():
    assert packing.lower_bound(np.array([16] * 10), 30) == 10 and packing.lower_bound(np.array([11] * 9), 30) == 5


@pytest.mark.parametrize("per_partition", [4, 4096])
def test_pack(spark, per_partition):
    rng = random.Random(2)
    sizes = {i: rng.choice([None, 0, 1, 7, 20, 33, 50, 99, 100, 101, 350]) for i in range(400)}
    tokens = spark.createDataFrame(list(sizes.items()), "doc_id long, n_tokens long").withColumn("stage", F.lit("clash"))
    stages = spark.createDataFrame([("x", 100, None, 1), ("x", 100, None, 1), ("y", 64, None, 1), ("bad", 0, None, 1)], STAGES)
    rows = packing.pack(tokens, stages, per_partition=per_partition).collect()
    for stage, capacity in (("x", 100), ("y", 64)):
        own = [r for r in rows if r["stage"] == stage]
        total, fill = {}, {}
        for r in sorted(own, key=lambda r: (r["container"] or "", r["position"] or 0)):
            total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
            if r["n_tokens"] == 0:
                assert r["container"] is None and r["position"] is None
                continue
            assert fill.get(r["container"], 0) == r["position"]
            fill[r["container"]] = r["position"] + r["n_tokens"]
        assert total == {i: n or 0 for i, n in sizes.items()} and max(fill.values()) <= capacity
        assert all(sum(r["doc_id"] == i for r in own) == 1 for i, n in sizes.items() if (n or 0) <= capacity)
        assert len(fill) <= 1.2 * sum(n or 0 for n in sizes.values()) / capacity + 1
    assert {r["stage"] for r in rows} == {"x", "y"}


def test_pack_of_nothing(spark):
    stages = spark.createDataFrame([("x", 100, None, 1)], STAGES)
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), stages).count() == 0


def test_shortfalls_come_from_the_histogram(spark, monkeypatch):
    levels, plain = [], mixing._histogram
    monkeypatch.setattr(mixing, "_histogram", lambda hashed, level: levels.append(level) or plain(hashed, level))
    stages = spark.createDataFrame([("s", {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 0.0, "f": None}, 400)], "name string, mixture map<string, double>, budget_residues long")
    rows = spark.createDataFrame([("s", "b", True, 2), ("s", "c", False, 9)], "stage string, source string, allow_resampling boolean, max_epochs int")
    released = spark.createDataFrame([(i, s, "train", n) for i, (s, n) in enumerate([("a", 60), ("a", 40), ("b", 25), ("b", 25), ("c", 99)])], "record_id long, source string, split string, length int")
    # 100 each: a has just that, b in two passes, c has one residue too few and one pass, d has no rows
    assert sorted(map(tuple, mixing.shortfalls(stages, rows, released).collect())) == [("s", "c"), ("s", "d")] and levels == [0]


@pytest.mark.parametrize("parts", [24, 64, 640])
def test_second_exchange_pools_other_partitions(spark, parts):
    rows = spark.range(parts).select(*[packing.pool_of(F.col("id"), F.lit(parts), n).alias(f"p{n}") for n in (1, 2)]).collect()
    for pool in {r["p2"] for r in rows}:
        first = [r["p1"] for r in rows if r["p2"] == pool]
        assert len(first) == packing.POOL and len(set(first)) >= 3


def test_report_and_check_with_exchanges(spark):
    rng = random.Random(21)
    tokens = spark.createDataFrame([(i, rng.choice([0, 5, 21, 26, 33, 34, 40, 51, 67, 100, 230])) for i in range(1500)] + [(5000, None)], "doc_id long, n_tokens long")
    stages = spark.createDataFrame([("a", 100), ("b", 100), ("c", 64), ("d", None), (None, 7), ("e", 0)], "name string, context_length int")
    rows = {r["stage"]: r for r in packing.packing_report(tokens, stages, per_partition=16).collect()}
    assert set(rows) == {"a", "b", "c"} and all(r["partitions"] > 20 for r in rows.values())
    for r in rows.values():
        assert 0 <= r["gap_after"] <= r["gap_before"] and r["containers"] == r["bound"] + r["gap_after"]
    assert rows["a"]["gap_before"] > rows["a"]["gap_after"], "the exchanges save containers here"
    placed = packing.pack(tokens, stages, per_partition=16)
    assert {r["stage"]: r["n"] for r in placed.where("container IS NOT NULL").groupBy("stage").agg(F.countDistinct("container").alias("n")).collect()} == {k: r["containers"] for k, r in rows.items()}
    got = sorted(map(tuple, packing.packing_check(tokens, stages).collect()))
    empty = tokens.where("coalesce(n_tokens, 0) = 0").count()
    assert got == [(s, c, 1501, empty, 0, 0, 0, 0) for s, c in [("a", 100), ("b", 100), ("c", 64)]]


def test_domain_counts_ids_that_share_a_number(spark, monkeypatch):
    ids = spark.createDataFrame([("a",), ("a",), ("0123456789",), ("01234567890",), ("",), ("é",), (None,)], "chain_id string")
    assert tuple(sampling.domain_check(ids).first()) == (5, 2, 3, 0)
    monkeypatch.setattr(sampling, "chain_number", lambda c: F.when(F.length(c) == 1, F.lit(5)).otherwise(F.lit((1 << 60) + 1)).cast("bigint"))
    assert tuple(sampling.domain_check(ids).first()) == (5, 2, 3, 5)
    assert tuple(sampling.domain_check(ids.limit(0)).first()) == (0, 0, 0, 0)


def test_bit_map_holds_all_keys(spark):
    from strandwork.llm import bits

    keys = [int(x) for x in np.random.default_rng(3).integers(-(1 << 62), 1 << 62, 3000)]
    df = spark.createDataFrame([(k,) for k in keys], "key long").repartition(5)
    for size in (1 << 16, 1 << 22):
        words = bits.bit_map(df, size)
        assert len(bits.present(words, np.array(keys).view(np.uint64), size)) == len(keys)
        others = np.random.default_rng(4).integers(0, 1 << 62, 3000).view(np.uint64)
        assert len(bits.present(words, others, size)) < (60 if size == 1 << 16 else 5)
    assert not bits.bit_map(df.limit(0), 1 << 16).any()
