import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandwork.operators import contacts, corpus, masking, planning, reports, sampling
from strandwork.operators.ordering import ranked


def test_ranked_matches_a_plain_count(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, 1, 5])) for i in range(300)]
    out = ranked(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], ["k"], "v").collect()
    assert len(out) == 300
    for g in ("a", "b", None):
        seen = total = 0
        for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["k"]):
            seen += 1
            assert (r["rn"], r["before"]) == (seen, total)
            total += r["v"] or 0


def test_ranked_empty(spark):
    assert ranked(spark.createDataFrame([], "g string, k int"), ["g"], ["k"]).count() == 0


def sequential(rows, cap):
    out = []
    for source in sorted({s for s, _, _ in rows}):
        current = []
        for _, digest, length in sorted(r for r in rows if r[0] == source):
            if current and sum(x for _, x in current) + length > cap:
                out.append((source, len(current), sum(x for _, x in current), current[0][0], current[-1][0]))
                current = []
            current.append((digest, length))
        if current:
            out.append((source, len(current), sum(x for _, x in current), current[0][0], current[-1][0]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_pack_shards_equals_the_sequential_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), f"{i:05d}", rng.choice([1, 10, 40, 99, 250])) for i in rng.sample(range(9999), 120)]
    got = planning.pack_shards(spark.createDataFrame(rows, "source string, digest string, length int"), 100).collect()
    assert sorted((r["source"], r["records"], r["residues"], r["least_digest"], r["greatest_digest"]) for r in got) == sequential(rows, 100)


def test_plan_by_shards_equals_the_greedy_loop(spark):
    rng = random.Random(4)
    weights = {"uniref90": 36.0, "mgnify": 11.0, "omg_img": 54.0}
    rows = [(s, i, rng.choice([900, 1000, 1100])) for s in weights for i in range(40)]
    shards = spark.createDataFrame(rows, "source string, shard long, records long")
    equal = spark.createDataFrame([(s, i, 1000) for s, i, _ in rows], "source string, shard long, records long")
    assert {r["source"]: r["count"] for r in planning.plan_by_shards(equal, weights, 7).groupBy("source").count().collect()} == {"uniref90": 3, "mgnify": 1, "omg_img": 3}
    for count in (7, 30, 69):
        at, held, wanted = dict.fromkeys(weights, 0), dict.fromkeys(weights, 0), []
        for _ in range(count):
            s = min(weights, key=lambda x: held[x] / weights[x])
            wanted.append((s, at[s]))
            held[s] += next(n for x, i, n in rows if (x, i) == (s, at[s]))
            at[s] += 1
        got = [(r["source"], r["shard"]) for r in planning.plan_by_shards(shards, weights, count).orderBy("pick").collect()]
        assert got == wanted


def test_balance_golden():
    assert reports.balanced_groups([512, 480, 448, 416, 128, 96, 64, 32], 4) == [[0, 7], [1, 6], [2, 5], [3, 4]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 512), min_size=4, max_size=40), st.integers(1, 4))
def test_balance_never_worse(lengths, world):
    lengths = lengths[: len(lengths) // world * world]
    groups = reports.balanced_groups(lengths, world)
    room = len(lengths) // world
    assert sorted(i for g in groups for i in g) == list(range(len(lengths))) and all(len(g) == room for g in groups)
    blocks = [sum(lengths[r * room : (r + 1) * room]) for r in range(world)]
    assert max(sum(lengths[i] for i in g) for g in groups) <= max(blocks)


def test_losses_golden(spark):
    units = spark.createDataFrame([("x", 4, 4.0), ("x", 16, 3.0), ("x", 64, 2.0), ("z", 0, 0.0)], "source string, n_targets int, loss double")
    rows = {r["source"]: r for r in masking.loss_report(units, ["source"]).collect()}
    assert (rows["x"]["macro_loss"], rows["x"]["root_loss"], rows["x"]["target_loss"]) == (3.0, 2.571429, 2.285714)
    assert rows["z"]["zero_target_units"] == 1 and rows["z"]["macro_loss"] == 0


def test_two_rank_normalisation(spark):
    units = spark.createDataFrame([(4, 4.0), (64, 2.0)], "n_targets int, loss double")
    assert masking.loss_report(units, []).first()["root_loss"] == 2.4


def test_mask_keeps_one_target(spark):
    rows = spark.createDataFrame([("d", "AXX"), ("e", "XXX"), ("f", ""), ("g", None), ("h", "ACDEFGHIKL" * 200)], "digest string, norm string")
    out = {r["digest"]: r for r in masking.masked(rows, 1).collect()}
    assert out["d"]["targets"] == [1] and out["e"]["targets"] == [] and out["f"]["targets"] == [] and "g" not in out
    assert len(out["h"]["crop"]) == 510 and 40 < len(out["h"]["targets"]) < 120


def test_parameter_count_golden(spark):
    c = [F.lit(768), F.lit(24), F.lit(64)]
    row = spark.range(1).select(reports.parameter_count(*c, F.lit(False), F.lit(False), F.lit(False)).alias("a"), reports.parameter_count(*c, F.lit(True), F.lit(True), F.lit(False)).alias("b")).first()
    assert (row["a"], row["b"]) == (170_671_168, 170_559_856)


def test_draws_do_not_depend_on_world(spark):
    weights = {"a": 0.5, "b": 0.25, "c": 0.25}
    one = sampling.mixture_draws(spark, weights, 500, 1, 64, 1).select("draw", "source").collect()
    four = sampling.mixture_draws(spark, weights, 500, 1, 64, 4).select("draw", "source").collect()
    assert sorted(one) == sorted(four)


def test_draws_cover_an_epoch_once(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)], "source string, record_id long")
    draws = spark.range(20).select(F.col("id").alias("draw"), F.lit("a").alias("source"))
    out = sampling.drawn_rows(draws, rows, 5).collect()
    for epoch in (0, 1):
        assert sorted(r["record_id"] for r in out if r["epoch"] == epoch) == list(range(7))
    assert len(out) == 20


def test_reward_gate():
    trials = [(1, 0.3, 0.30, 0.01), (2, 0.29, 0.5, 0.0), (3, 0.32, 0.305, 0.002), (4, 0.33, 0.33, 0.02), (5, 0.33, 0.36, 0.015), (6, 0.4, 0.4, 0.01)]
    assert [d for _, d, _, _ in reports.reward_gate(trials)] == ["baseline", "discard_early", "discard", "keep", "discard_early", "keep"]


def test_average_precision_with_ties(spark):
    rows = spark.createDataFrame([("g", 0.9, True), ("g", 0.5, True), ("g", 0.5, False), ("g", 0.1, False), ("h", 0.5, False)], "grp string, score double, target boolean")
    out = {r["grp"]: r["average_precision"] for r in contacts.average_precision(rows).collect()}
    assert out["g"] == round(0.5 * 1 + 0.5 * 2 / 3, 6) and out["h"] is None


def test_funnel_conserves_rows(spark):
    released = spark.createDataFrame(
        [(1, "uniref90", "train", "p", "A" * 70, None, 70), (1, "uniref90", "train", "p", "A" * 70, None, 70), (2, None, "train", "p", "A" * 70, None, None), (3, "mgnify", "train", "p", None, None, 1), (4, "mgnify", "train", "p", "C" * 70, "AB", 70), (5, "mgnify", "train", "p", "D" * 70, None, 70), (6, "mgnify", "validation", "p", "d" * 70, None, 70), (7, "mgnify", "train", "p", "E" * 70, "CD", 70), (8, "zz", "train", "p", "F" * 70, None, 70)],
        "record_id long, source string, split string, path string, sequence string, sha256 string, length int",
    )
    evaluation = spark.createDataFrame([("c" * 70, None)], "sequence string, evaluation_sha256 string")
    hits = spark.createDataFrame([("x", "cd", 95.0, 0.9, 0.9, 1e-9), ("x", "zz", None, 0.9, 0.9, 1e-9)], "evaluation_sha256 string, training_sha256 string, pident double, evaluation_coverage double, training_coverage double, evalue double")
    got = {r["record_id"]: r["reason"] for r in corpus.funnel(released, evaluation, hits).collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "missing", 4: "protected_exact", 5: "validation", 7: "protected_homology", 8: "kept"}


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_equals_walking(spark, seed):
    rng = random.Random(seed)
    sizes = {"a": (400, 9), "b": (1, 5), "c": (150, 60), "d": (90, 14)}
    rows = [(s, f"{i:05}", rng.choice([0, 1, rng.randrange(1, most), most])) for s, (n, most) in sizes.items() for i in range(n)]
    cap, wanted = [20, 7][seed - 1], []
    for s in sizes:
        held = None
        for _, digest, size in sorted(r for r in rows if r[0] == s):
            if held is None or held + size > cap:
                held = 0
                wanted.append([s, sum(w[0] == s for w in wanted), 0, 0, digest, digest])
            held += size
            wanted[-1][2:] = [wanted[-1][2] + 1, wanted[-1][3] + size, wanted[-1][4], digest]
    frame = spark.createDataFrame(rows, "source string, digest string, length long")
    columns = ["source", "shard", "records", "residues", "least_digest", "greatest_digest"]
    assert sorted(tuple(r[c] for c in columns) for r in planning.pack_shards(frame, cap).collect()) == sorted(map(tuple, wanted))
