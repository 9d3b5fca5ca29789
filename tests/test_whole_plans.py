"""Queries that do the whole of a job of which an older query does a part."""

import hashlib
import random
import re

import duckdb

from strandwork.operators import contacts, corpus
from strandwork.plans import catalog


def digest_of(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_config_differences_of_every_source(spark, tmp_path):
    rows = [("base_512", 512, 8, 1, 100, {"uniref90": 0.5, "omg_img": 0.3731, "deep_sea": None}), ("polish_512", 512, 4, 1, 200, {"uniref90": 0.5, "omg_img": 20.182, "brine_pool": 5.9}), ("other", 1, 1, 1, 1, None)]
    columns = "name string, context_length int, micro_batch_size int, gradient_accumulation int, budget_residues long, mixture map<string, double>"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/stages.parquet")
    got = sorted(map(tuple, catalog.queries()["config_differences_all"](spark, str(tmp_path)).collect()))
    assert got == [("micro_batch_size", "8", "4"), ("mixture.brine_pool", None, "5.9"), ("mixture.omg_img", "0.3731", "20.182")]


def test_validation_is_whole_and_eligible(spark, tmp_path):
    rng = random.Random(2)
    words = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=60)) for _ in range(30)]
    bad = [words[0][:59], "A" * 16385, "X" * 13 + words[0][:47]]
    rows = [(k, "mgnify", "validation", s, digest_of(s)) for k, s in enumerate(words + bad)]
    rows += [(100, "uniref90", "validation", words[0].lower(), None), (101, None, "validation", words[1], None), (102, "mgnify", "train", words[0] * 2, None)]
    released = spark.createDataFrame(rows, "record_id long, source string, split string, sequence string, sha256 string").selectExpr("*", "'' AS path", "length(sequence) AS length")
    evaluation = spark.createDataFrame([(words[2], None), (None, digest_of(words[3]).upper())], "sequence string, evaluation_sha256 string")
    hits = spark.createDataFrame([("q", digest_of(words[4]), 90.0, 0.9, 0.9, 1e-9), ("q", digest_of(words[5]), 10.0, 0.9, 0.9, 1e-9)], "evaluation_sha256 string, training_sha256 string, pident double, evaluation_coverage double, training_coverage double, evalue double")
    for name, df in (("released_sequences", released), ("evaluation_sequences", evaluation), ("homology_hits", hits)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    # the first is uniref90's, the next is owned by mgnify, three are decontaminated: 26 of mgnify, more than 20
    wanted = sorted((digest_of(s), k) for k, s in enumerate(words) if k not in (0, 2, 3, 4))
    expected = [("mgnify", i + 1, h, k) for i, (h, k) in enumerate(wanted)] + [("uniref90", 1, digest_of(words[0]), 100)]
    assert sorted(map(tuple, catalog.queries()["validation_first_4096"](spark, str(tmp_path)).collect())) == expected
    assert [r["rn"] for r in corpus.validation_set(released, evaluation, hits, 3).where("source = 'mgnify'").orderBy("rn").collect()] == [1, 2, 3]


def test_pair_sample_keeps_every_pair_of_a_full_chain(spark, tmp_path):
    rows = [(p, p % 3, [float(p), 1.0]) for p in range(100)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["i"], r["j"]) for r in catalog.queries()["pair_sample_balanced_4096"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [(i, j) for i in range(100) for j in range(i + 24, 100)] and len(got) == 2926


def test_pair_sample_cap(spark):
    pairs = spark.range(4200).selectExpr("1 AS chain", "id AS i", "id + 24 AS j", "0.0 AS score", "id < 100 AS contact")
    got = contacts.balanced_pairs(pairs, 4096, 20260819).groupBy("contact").count().collect()
    assert sorted(map(tuple, got)) == [(False, 4096), (True, 100)]


def test_chain_precision_scores_every_pair_without_pair_rows(spark, tmp_path):
    rng = random.Random(7)
    words = {f"c{n}": "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=n)) for n in (1, 24, 25, 26, 33, 47, 48, 49, 130, 160, 161, 281, 700, 2500)}
    words |= {"same": "A" * 400, "odd": " mkv*\u00e9\u4e2d\U0001f600-" * 20 + "**", "empty": " *", "none": None, None: "A" * 90}
    rows = [*words.items(), ("c130", words["c161"]), ("c130", words["c130"].lower()), ("c281", None), ("c700", "")]
    path = f"{tmp_path}/cached_contact_chain.parquet"
    spark.createDataFrame(rows, "chain_id string, sequence string").coalesce(1).write.parquet(path)
    got = catalog.queries()["chain_precision"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW cached_contact_chain AS SELECT * FROM '{path}/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['chain_precision']})").fetchall()
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key) and len(expected) == 13
    # a sort of the pairs goes to disk: 0.31 GB for 0.3 MB of chains
    assert not re.search("Join|Window|Generate", got._jdf.queryExecution().executedPlan().toString())
