"""Operators that refuse, or report, what is broken."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandwork.operators import contacts, contracts, corpus, masking, planning, reports, sampling
from strandwork.runtime import scratch_dir
from strandwork.sources import readers, writers
from strandwork.streaming import ingest


def covered(spark):
    rows = [("s", "a", 10.0, 12, 20, 0, 20, True, False), ("s", "b", 10.0, 12, 5, 0, 5, False, False), ("t", "a", 10.0, 12, 9, 0, 9, False, True), ("u", "a", 1.0, 4, 50, 0, 50, True, False)]
    return spark.createDataFrame(rows, "stage string, source string, expected_draws double, required long, available long, consumed long, unused long, sufficient boolean, allowed boolean")


def test_policies(spark):
    got = {(r["stage"], r["policy"]): (r["sources"], r["insufficient"], r["status"], r["refused"]) for r in planning.policy_outcomes(covered(spark)).collect()}
    assert got[("s", "error")] == (2, 1, "insufficient", True) and got[("s", "allow")] == (2, 1, "insufficient", False)
    assert got[("t", "per_source")] == (1, 0, "passed", False) and got[("t", "error")] == (1, 1, "insufficient", True)
    assert planning.require_coverage(covered(spark), "allow").count() == 4 and planning.require_coverage(covered(spark).where("stage <> 's'"), "per_source").count() == 2
    for policy, headroom in (("error", 0.01), ("per_source", 0.01), ("maybe", 0.01), ("allow", -1.0), ("allow", float("inf"))):
        with pytest.raises(ValueError):
            planning.require_coverage(covered(spark), policy, headroom)


def test_strict_sources_are_checked_before_any_draw(spark):
    got = {(r["stage"], r["source"]): (r["exhausted"], r["refused"], r["granted"]) for r in planning.strict_check(covered(spark)).collect()}
    assert got == {("s", "a"): (False, True, 0), ("s", "b"): (True, True, 0), ("t", "a"): (False, False, 10), ("u", "a"): (False, False, 1)}


def test_manifest_rules_report_each_fault(spark):
    h = lambda n: f"{n:064x}"
    good = [("a", "train", "a/train/0", 3, 9, h(1), h(5)), ("a", "train", "a/train/1", 3, 9, h(6), h(9)), ("a", "validation", "a/validation/0", 1, 1, h(2), h(2))]
    schema = "source string, split string, path string, records long, residues long, least_digest string, greatest_digest string"
    check = lambda rows: {r["rule"]: r["violations"] for r in planning.shard_rules(spark.createDataFrame(rows, schema)).collect() if r["violations"]}
    assert check(good) == {}
    bad = [*good, ("a", "train", "a/train/2", 0, 9, h(9), h(12)), ("b", "train", "/b/../x", 1, 1, "XY", None), ("b", "train", "/b/../x", 1, 1, h(1), h(2))]
    assert check(bad) == {"path_unique": 2, "path_relative": 2, "path_named": 2, "holds_records": 1, "digests_formed": 1, "digests_rise": 2, "both_splits": 2}


def test_states_that_moved_or_lost_draws(spark):
    ranks = spark.createDataFrame([("a", 0, 3), ("a", 1, 4), ("b", 0, 2)], "source string, rank int, n long")
    drawn = spark.createDataFrame([("a", 1, 1), ("a", 0, 4), ("b", 0, 2)], "source string, epoch int, position long")
    sizes = spark.createDataFrame([("a", 5), ("b", 9)], "source string, size long")
    got = {r["source"]: (r["counted"], r["epoch"], r["cursor"], r["agrees"]) for r in sampling.portable_check(ranks, drawn, sizes).collect()}
    assert got == {"a": (7, 1, 2, True), "b": (2, 0, 3, False)}
    schema = "stage string, source string, size long, seed long, epoch int, epoch_cursor long, allowed boolean"
    contract = [("s", "a", 5, 1, 0, 0, True), ("s", "b", 5, 1, 0, 0, False), ("s", "c", 5, 1, 0, 0, False), ("s", "d", 5, 1, 0, 0, False)]
    saved = [("s", "a", 5, 1, 2, 5, True), ("s", "b", 5, 1, 1, 2, False), ("s", "c", 6, 1, 0, 2, False)]
    got = {r["source"]: (r["valid"], r["restored"]) for r in sampling.restored(spark.createDataFrame(saved, schema), spark.createDataFrame(contract, schema)).collect()}
    assert got["a"] == (True, True) and got["b"] == (False, True) and got["c"] == (True, False) and not got["d"][1]


def test_migration_needs_each_row_once(spark):
    rows = spark.range(100).selectExpr("id AS record_id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS source", "id < 60 AS old")
    got = {r["source"]: (r["old_size"], r["new_size"], r["consumed"], r["queue"], r["valid"]) for r in sampling.migration(rows, 1, 2, 4, 3).collect()}
    assert got == {"a": (20, 34, 12, 22, True), "b": (40, 66, 12, 54, True)}


def test_origins(spark):
    df = spark.createDataFrame([(1, "1234567"), (2, "MGYG1"), (3, None), (4, "zzz")], "doc_id long, accession string")
    assert {r["doc_id"]: (r["class"], r["kept"]) for r in corpus.excluding_origin(df).collect()} == {1: ("img", True), 2: ("mgnify_origin", False), 3: ("missing", True), 4: ("unclassified", True)}
    assert corpus.excluding_origin(df.where("doc_id < 4"), strict=True).count() == 3
    with pytest.raises(Exception, match="unclassified accession: zzz"):
        corpus.excluding_origin(df, strict=True).collect()


def test_stores_and_receipts_refuse(spark, tmp_path):
    rows = spark.createDataFrame([("a", hashlib.sha256(b"LAG").hexdigest(), "LAG")], "source string, digest string, norm string")
    with pytest.raises(ValueError, match="no records for b"):
        writers.token_store(rows, str(tmp_path / "s"), ["a", "b"])
    with pytest.raises(ValueError):
        writers.receipt(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "r"))
    first = writers.receipt(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "r"))
    assert first == writers.receipt(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "q")) and first == hashlib.sha256(b'{"x":1}\n').hexdigest()
    units = spark.createDataFrame([("u", [32, 5], [4, -100]), ("u", [5], [-100])], "unit string, tokens array<int>, labels array<int>")
    with pytest.raises(ValueError, match="twice"):
        writers.mask_cache(units, str(tmp_path / "m"))
    assert tuple(writers.mask_cache(units.limit(1), str(tmp_path / "n")).first()) == (1, 2, 1)
    assert readers.missing_paths(spark, str(tmp_path), ["r", "nowhere"]) == ["nowhere"]
    files = spark.createDataFrame([("x", "ab"), ("y", "cd")], "name string, sha256 string")
    bound = readers.bound_payloads(files, spark.createDataFrame([("x", "AB"), ("z", "ef")], "name string, declared string"))
    assert {r["name"]: r["bound"] for r in bound.collect()} == {"x": True, "y": False, "z": False}


def test_corruption_hides_targets_only(spark):
    rows = spark.createDataFrame([("ACDEFG", hashlib.sha256(b"ACDEFG").hexdigest()), ("XX", "0"), ("", "1")], "norm string, digest string")
    for r in masking.corrupted(masking.masked(rows, 7)).collect():
        assert len(r["tokens"]) == len(r["labels"]) == len(r["norm"])
        assert [i + 1 for i, t in enumerate(r["tokens"]) if t == 32] == sorted(r["targets"]) == [i + 1 for i, t in enumerate(r["labels"]) if t != -100]


def test_ordered_digest_sees_order_and_content(spark, monkeypatch):
    monkeypatch.setattr(reports, "DIGEST_CHUNK", 2)
    make = lambda rows: {r["g"]: (r["units"], r["digest"]) for r in reports.ordered_digest(spark.createDataFrame([("g", i, t) for i, t in rows], "g string, n long, t string"), "g", "n", "t").collect()}
    rows = [(i, f"t{i}") for i in range(11)]
    sha = lambda xs: hashlib.sha256("\n".join(xs).encode()).hexdigest()
    pairs = lambda xs: [sha(xs[i : i + 2]) for i in range(0, len(xs), 2)]
    assert make(rows)["g"] == (11, sha(pairs(pairs([t for _, t in rows])))) == make(rows[::-1])["g"]
    assert make([(0, "t1"), (1, "t0"), *rows[2:]]) != make(rows)


def test_streams_go_on_in_their_folder(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "run")
    put = lambda n, ids: spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.parquet(str(source / f"p={n}"))
    put(0, [1, 2, 2])
    stream = lambda: ingest.deduplicated(spark.readStream.schema("id long, p int").parquet(str(source)).select("id"), "id")
    assert ingest.drain(stream(), "x", folder=folder).count() == 2
    put(1, [2, 3])
    assert sorted(r["id"] for r in ingest.drain(stream(), "x", folder=folder).collect()) == [1, 2, 3]
    timed = spark.readStream.schema("id long, p int").parquet(str(source)).selectExpr("id", "timestamp'2024-01-01' AS at")
    assert sorted(r["id"] for r in ingest.drain(ingest.deduplicated(timed, "id", "at", "1 day"), "y").collect()) == [1, 2, 3]


def test_scratch_is_shared(spark):
    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Fake)
    assert scratch_dir(spark)


def test_selected_probe_makes_a_bound_receipt(spark):
    rows = [(i, i % 2, [float(i % 2) + 0.01 * i, 0.5, float(i % 5)]) for i in range(60)]
    df = spark.createDataFrame([(i, 1 - int(v[0] > 0.9), v) for i, _, v in rows], "vec_id long, label int, embedding array<float>")
    strength, coefficients, intercept, trace = contacts.selected_probe(df, (0.1, 10.0))
    bound = {"dataset_manifest_sha256": "d", "channels": 3}
    assert contracts.probe_problems(contracts.probe_receipt(coefficients, intercept, strength, trace, bound), bound, 3) == [] and len(trace) == 2


def test_shards_are_found_again(spark):
    rows = spark.createDataFrame([(s, f"{i:03}", 1 + (i * 7) % 9) for s, n in (("a", 40), ("b", 3)) for i in range(n)], "source string, digest string, length long")
    shards = planning.pack_shards(rows, 20)
    got = planning.shard_of(rows, shards).groupBy("source", "shard").agg(F.count("*").alias("records"), F.sum("length").alias("residues"))
    assert sorted(map(tuple, got.collect())) == sorted((r["source"], r["shard"], r["records"], r["residues"]) for r in shards.collect())
