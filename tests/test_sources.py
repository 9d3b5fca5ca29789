import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandwork.operators import planning
from strandwork.sources import readers, writers


def test_manifest(spark, tmp_path):
    shard = {"path": "a/train/s-0.parquet", "sha256": "0" * 64, "records": 3, "residues": 9, "bytes": 5, "minimum_sequence_sha256": "1", "maximum_sequence_sha256": "2"}
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"protocol": "x", "sources": {"a": {"train": [shard, shard | {"records": 4}], "validation": []}, "b": {"train": [], "validation": [shard]}}}, indent=1))
    rows = readers.release_manifest(spark, str(path)).collect()
    assert sorted((r["source"], r["split"], r["ordinal"], r["records"]) for r in rows) == [("a", "train", 0, 3), ("a", "train", 1, 4), ("b", "validation", 0, 3)]


def test_json_ids_payloads(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"chain_id": "a", "n": 1}\n{"chain_id": "b"}\n')
    assert [(r["chain_id"], r["n"]) for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "chain_id string, n int").collect()] == [("a", 1), ("b", None)]
    (tmp_path / "a.json").write_text('[{"chain_id": "a"},\n {"chain_id": "b"}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "chain_id string").count() == 2
    (tmp_path / "ids.txt").write_text("z\na\nm\n")
    assert [r["id"] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).orderBy("ordinal").collect()] == ["z", "a", "m"]
    (tmp_path / "p.bin").write_bytes(b"payload")
    assert readers.payloads(spark, str(tmp_path / "p.bin")).first()["sha256"] == hashlib.sha256(b"payload").hexdigest()


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">one first record\nACD\nEF\n>two\nGH\n>three empty\n")
    rows = {r["name"]: (r["description"], r["sequence"]) for r in readers.fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert rows == {"one": ("first record", "ACDEF"), "two": (None, "GH"), "three": ("empty", "")}


def test_packed_bits(spark):
    df = spark.createDataFrame([(bytes([0b00000101, 0b1]), 10), (b"", 0)], "b binary, n int")
    assert [r["x"] for r in df.select(readers.packed_bits("b", "n").alias("x")).collect()] == [[True, False, True, False, False, False, False, False, True, False], []]


def test_token_store_and_release(spark, tmp_path):
    rows = spark.createDataFrame([("a", hashlib.sha256(s.encode()).hexdigest(), s) for s in ("LAG", "VS", "ERTI")] + [("b", "00", "L"), ("b", "01", None)], "source string, digest string, norm string")
    path = str(tmp_path / "store")
    got = {r["source"]: (r["records"], r["residues"], r["closed"]) for r in writers.token_store(rows, path).collect()}
    assert got == {"a": (3, 9, True), "b": (1, 1, True)}
    with pytest.raises(Exception):
        writers.token_store(rows, path)
    sized = rows.where("norm IS NOT NULL").withColumn("length", F.length("norm"))
    shards = planning.pack_shards(sized.select("source", "digest", "length"), 5)
    writers.sharded_release(rows.where("norm IS NOT NULL"), shards, str(tmp_path / "release"))
    assert spark.read.parquet(str(tmp_path / "release")).count() == 4


def test_receipt_and_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "n int, s string")
    writers.receipt(df, str(tmp_path / "r"))
    writers.append_log(df, str(tmp_path / "log"))
    writers.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2 and spark.read.json(str(tmp_path / "r")).count() == 1
