"""Sinks: token stores, sharded releases, manifests, caches, receipts, logs.

Every store is written under a new path and refused if that exists; the output committer puts the files in
place once all tasks have ended.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequence import token_ids
from strandwork.operators.ordering import ranked
from strandwork.operators.planning import shard_of


def token_store(rows: DataFrame, path: str, expected: Iterable[str] = ()) -> DataFrame:
    """Write ``source, row_index, token_offset, length, digest, tokens`` per source and return the receipt.

    ``rows``: ``source, digest, norm``. Rows go in digest order. Null sequences are left out; a source of
    ``expected`` without rows is refused.
    """
    sized = rows.where("norm IS NOT NULL AND source IS NOT NULL").withColumn("length", F.length("norm").cast("bigint"))
    placed = ranked(sized, ["source"], ["digest"], "length")
    store = placed.select("source", (F.col("rn") - 1).alias("row_index"), F.col("before").alias("token_offset"), "length", F.unhex("digest").alias("digest"), token_ids(F.col("norm")).cast("array<tinyint>").alias("tokens"))
    store.write.mode("errorifexists").partitionBy("source").parquet(path)
    back = rows.sparkSession.read.schema(store.schema).parquet(path)
    receipt_ = back.groupBy("source").agg(F.count("*").alias("records"), F.sum("length").alias("residues"), (F.max(F.col("token_offset") + F.col("length")) == F.sum("length")).alias("closed"))
    empty = set(expected) - {r["source"] for r in receipt_.select("source").collect()}
    if empty:
        raise ValueError("no records for " + ", ".join(sorted(empty)))
    return receipt_


def sharded_release(rows: DataFrame, shards: DataFrame, path: str) -> None:
    """Write records (``source, digest, norm``) into their shards (``pack_shards`` rows), sorted by digest, a folder each."""
    placed = shard_of(rows.select("source", "digest", "norm"), shards)
    out = placed.select("source", "shard", F.col("norm").alias("sequence"), F.col("digest").alias("sha256"), F.length("norm").alias("length"))
    out.repartitionByRange("source", "shard").sortWithinPartitions("source", "shard", "sha256").write.mode("errorifexists").partitionBy("source", "shard").parquet(path)


def release_manifest(shards: DataFrame, path: str) -> None:
    """The shards of a train release (``pack_shards`` rows) as one nested JSON document; it is as long as the shard table."""
    entry = F.struct(
        "shard",
        F.struct(
            F.concat(F.lit("source="), "source", F.lit("/shard="), F.col("shard").cast("string")).alias("path"),
            "records",
            "residues",
            F.col("least_digest").alias("minimum_sequence_sha256"),
            F.col("greatest_digest").alias("maximum_sequence_sha256"),
        ).alias("e"),
    )
    per = shards.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("train"))
    one = per.agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("train").alias("splits")))).alias("sources"))
    receipt(one, path)


def receipt(df: DataFrame, path: str) -> str:
    """A one-row result as a JSON document, put in place at once; returns its SHA-256. Numbers that JSON lacks are refused."""
    odd = [F.bool_or(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c, kind in df.dtypes if kind in ("double", "float")]
    if odd and any(df.agg(*odd).first()):
        raise ValueError("not a number, or infinite")
    df.coalesce(1).write.mode("overwrite").json(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    return files.agg(F.max(F.sha2("content", 256))).first()[0]


def json_array(df: DataFrame, path: str) -> None:
    """The rows of a small table as one JSON array."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns)))).coalesce(1).write.mode("errorifexists").text(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log."""
    df.write.mode("append").json(path)


def id_list(df: DataFrame, key: str, path: str) -> None:
    """Ids one a line, in the order of the ids, over as many files as there are tasks."""
    df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("value")).orderBy("value").write.mode("errorifexists").text(path)


def fasta(rows: DataFrame, path: str) -> None:
    """``name, sequence`` as FASTA text, a record after another; null sequences are left out."""
    rows.where("sequence IS NOT NULL").select(F.concat(F.lit(">"), F.col("name").cast("string"), F.lit("\n"), "sequence").alias("value")).write.mode("errorifexists").text(path)


def payloads(rows: DataFrame, name: str, order: list[str], line: str, path: str) -> None:
    """One text file per ``name``, its lines in ``order``. A payload is a document, and is written by one task."""
    spread = rows.repartition(name).sortWithinPartitions(name, *order)
    spread.select(name, F.col(line).alias("value")).write.mode("errorifexists").partitionBy(name).text(path)


def mask_cache(rows: DataFrame, path: str) -> DataFrame:
    """Write masked examples (``unit, tokens, labels``) and return ``units, distinct_units, tokens, targets`` of what was written.

    A unit that occurs twice is refused.
    """
    rows.select("unit", "tokens", "labels").write.mode("errorifexists").parquet(path)
    back = rows.sparkSession.read.schema(rows.select("unit", "tokens", "labels").schema).parquet(path)
    per = back.groupBy("unit").agg(F.count("*").alias("n"))
    if not per.where("n > 1").isEmpty():
        raise ValueError("a unit occurs twice")
    return back.agg(F.count("*").alias("units"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size(F.filter("labels", lambda x: x != -100))).alias("targets"))


def contact_cache(masks: DataFrame, path: str) -> DataFrame:
    """Write ``chain, n_pairs, valid, contact`` (bit masks) with their byte offsets, and return the entries.

    Offsets run over the chains in order, the valid mask of a chain before its contact mask, as in one file.
    """
    sized = masks.withColumn("valid_bytes", F.length("valid").cast("bigint")).withColumn("contact_bytes", F.length("contact").cast("bigint"))
    placed = ranked(sized.withColumn("both", F.col("valid_bytes") + F.col("contact_bytes")), [], ["chain"], "both")
    out = placed.select("chain", "n_pairs", F.col("before").alias("valid_offset"), "valid_bytes", (F.col("before") + F.col("valid_bytes")).alias("contact_offset"), "contact_bytes", "valid", "contact")
    out.write.mode("errorifexists").parquet(f"{path}/masks")
    entries = masks.sparkSession.read.schema(out.schema).parquet(f"{path}/masks").drop("valid", "contact")
    append_log(entries, f"{path}/entries")
    return entries
