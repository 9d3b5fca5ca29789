"""Readers for the file formats of a sequence release; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwork.operators.ordering import ranked

RECORD = "sequence string, sha256 string, length int"
SHARD = "path string, sha256 string, records bigint, residues bigint, bytes bigint, minimum_sequence_sha256 string, maximum_sequence_sha256 string"


def shards(spark: SparkSession, *paths: str) -> DataFrame:
    """Release shards, projected to the three record columns."""
    return spark.read.schema(RECORD).parquet(*paths)


def pinned(spark: SparkSession, root: str, files: list[str], schema: str) -> DataFrame:
    """A version pinned as an explicit list of files or folders under ``root``; only those are listed and read.

    Columns that folder names hold (``name=value``) may be in ``schema``.
    """
    base = root.rstrip("/")
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])


def missing_paths(spark: SparkSession, root: str, files: list[str]) -> list[str]:
    """Those of a pinned list that aren't there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{f}")
        if not path.getFileSystem(conf).exists(path):
            out.append(f)
    return out


def release_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``source, split, ordinal`` and the shard descriptor, one row per shard of a nested manifest."""
    nested = f"sources map<string, struct<train: array<struct<{_struct(SHARD)}>>, validation: array<struct<{_struct(SHARD)}>>>>"
    doc = spark.read.schema(nested).option("multiLine", True).json(path)
    per = doc.select(F.explode("sources").alias("source", "splits"))
    parts = [per.select("source", F.lit(s).alias("split"), F.posexplode(f"splits.{s}").alias("ordinal", "shard")) for s in ("train", "validation")]
    return parts[0].unionByName(parts[1]).select("source", "split", "ordinal", "shard.*")


def _struct(fields: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split() for f in fields.split(", ")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal, id``: text files of ids, in file order; lines are numbered by file, place of the split, and place in it."""
    lines = spark.read.text(path).select(F.rtrim("value", F.lit("\r")).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return ranked(lines, [], ["file", "block", "place"]).select((F.col("rn") - 1).alias("ordinal"), "id")


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, sha256``: whole files with their digests (a payload is one cell)."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha256"))


def bound_payloads(files: DataFrame, inventory: DataFrame) -> DataFrame:
    """Payloads (``name, sha256, ...``) beside an inventory (``name, declared``): ``name, declared, sha256, bound``, with either side kept."""
    both = files.select("name", "sha256").join(inventory.select("name", F.lower("declared").alias("declared")), "name", "full_outer")
    return both.select("name", "declared", "sha256", F.coalesce(F.col("declared") == F.col("sha256"), F.lit(False)).alias("bound"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name, description, sequence``: records separated by ``>``, split in parallel."""
    chunks = spark.read.option("lineSep", "\n>").text(path).where(F.length(F.trim("value")) > 0)
    body = F.regexp_replace("value", "^>", "")
    head = F.substring_index(body, "\n", 1)
    rest = F.when(F.instr(body, "\n") > 0, F.expr("substring(regexp_replace(value, '^>', ''), instr(regexp_replace(value, '^>', ''), '\n') + 1)")).otherwise(F.lit(""))
    return chunks.select(F.substring_index(head, " ", 1).alias("name"), F.when(F.instr(head, " ") > 0, F.regexp_replace(head, "^\\S+\\s+", "")).alias("description"), F.regexp_replace(rest, "\\s", "").alias("sequence"))


def packed_bits(column: Column | str, count: Column | str) -> Column:
    """The first ``count`` bits of a binary column, least bit of each byte first, as an array of booleans."""
    data, n = F.col(column) if isinstance(column, str) else column, F.col(count) if isinstance(count, str) else count
    at = F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(data, (F.floor(i / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.transform(at, lambda i: F.pmod(F.floor(byte(i) / F.pow(F.lit(2), F.pmod(i, F.lit(8)))), F.lit(2)) == 1)
