"""Queries that write a store, release, cache or log to the scratch folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequence import normalised
from strandwork.operators import contacts, corpus, masking, planning, reports
from strandwork.operators.ordering import ranked
from strandwork.plans.corpus_plans import _IDS, PLAN_WEIGHTS, SHARD_CAP, packed_sql
from strandwork.plans.evaluation_plans import _PAIRS, _pairs
from strandwork.plans.registry import query
from strandwork.plans.sampling_plans import CUT, mask_sql
from strandwork.plans.sql import LETTERS, RECORDS, norm
from strandwork.runtime import scratch_path, settle, table
from strandwork.sources import readers, writers


def owned_rows(spark, d) -> DataFrame:
    """``source, digest, norm, length`` of the train records, each digest once per source."""
    rows = corpus.records(table(spark, d, "released_sequences"), "train").where("source IS NOT NULL AND digest IS NOT NULL")
    return settle(rows.groupBy("source", "digest").agg(F.first("norm").alias("norm"), F.max("norm_length").cast("bigint").alias("length")), "owned-rows")


def release_files(spark, d) -> tuple[DataFrame, DataFrame, str]:
    """The owned rows, their shards, and the folder of the sharded release written from them, with its manifest."""
    rows = owned_rows(spark, d)
    shards = settle(planning.pack_shards(rows.select("source", "digest", "length"), SHARD_CAP), "release-shards")
    root = scratch_path(spark, "release")
    writers.sharded_release(rows, shards, f"{root}/data")
    writers.release_manifest(shards, f"{root}/manifest")
    return rows, shards, root


@query(
    "release_write_read",
    f"{packed_sql(SHARD_CAP)} SELECT source, shard, records, residues, least_digest, greatest_digest, 0::BIGINT AS wrong_digests, 0::BIGINT AS disordered, true AS agrees FROM shards",
)
def release_write_read(spark, d):
    """The train release written in shards, its manifest read, the listed shards scanned and held against it.

    What each shard file holds is derived from its sequences; order is that of the rows in the file.
    """
    _, _, root = release_files(spark, d)
    manifest = settle(readers.release_manifest(spark, f"{root}/manifest"), "manifest").select("source", F.col("ordinal").cast("bigint").alias("shard"), "path", F.col("records").alias("declared_records"), F.col("residues").alias("declared_residues"), F.col("minimum_sequence_sha256").alias("declared_least"), F.col("maximum_sequence_sha256").alias("declared_greatest"))
    # one path per shard of the manifest
    files = [r["path"] for r in manifest.select("path").collect()]
    stored = readers.pinned(spark, f"{root}/data", files, f"{readers.RECORD}, source string, shard bigint")
    held = stored.select("source", "shard", F.length("sequence").cast("bigint").alias("size"), F.sha2("sequence", 256).alias("digest"), "sha256", F.monotonically_increasing_id().alias("place"))
    placed = ranked(held, ["source", "shard"], ["place"])
    prior = placed.select("source", "shard", (F.col("rn") + 1).alias("rn"), F.col("sha256").alias("prior"))
    found = placed.join(prior, ["source", "shard", "rn"], "left").groupBy("source", "shard").agg(
        F.count("*").alias("records"), F.sum("size").alias("residues"), F.min("digest").alias("least_digest"), F.max("digest").alias("greatest_digest"), F.count_if(F.col("digest") != F.col("sha256")).alias("wrong_digests"), F.count_if(F.col("sha256") <= F.col("prior")).alias("disordered")
    )
    agrees = F.lit(True)
    for a, b in (("records", "declared_records"), ("residues", "declared_residues"), ("least_digest", "declared_least"), ("greatest_digest", "declared_greatest")):
        agrees = agrees & F.col(a).eqNullSafe(F.col(b))
    return manifest.join(found, ["source", "shard"], "full_outer").select("source", "shard", "records", "residues", "least_digest", "greatest_digest", "wrong_digests", "disordered", agrees.alias("agrees"))


_ROWS = "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY digest) - 1 AS row_index FROM (SELECT source, digest, max(norm) AS norm, max(length(norm)) AS length FROM r WHERE split = 'train' AND source IS NOT NULL AND digest IS NOT NULL GROUP BY 1, 2))"


@query(
    "token_store_write_read",
    f"""WITH {RECORDS}, {_ROWS}, t AS (SELECT source, length, list_sum({_IDS})::BIGINT AS token_sum FROM o)
    SELECT source, count(*) AS records, sum(length)::BIGINT AS residues, true AS closed, coalesce(sum(token_sum), 0)::BIGINT AS token_sum FROM t GROUP BY source""",
)
def token_store_write_read(spark, d):
    """A token store of the train records, written and read back, with its receipt and the sum of its tokens."""
    rows, path = owned_rows(spark, d), scratch_path(spark, "tokens")
    arms = [r[0] for r in rows.select("source").distinct().collect()]
    receipt = writers.token_store(rows.select("source", "digest", "norm"), path, arms)
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)
    sums = spark.read.parquet(path).groupBy("source").agg(F.sum(total).alias("token_sum"))
    return receipt.join(sums, "source").select("source", "records", "residues", "closed", "token_sum")


@query(
    "token_store_fetch",
    f"""WITH {RECORDS}, {_ROWS}, q AS (SELECT DISTINCT source, row_index FROM token_store_index WHERE split = 'train' AND source IS NOT NULL)
    SELECT source, row_index, o.length, o.digest, list_sum(list_transform({_IDS}, lambda t, i: t * i))::BIGINT AS checksum FROM q JOIN o USING (source, row_index)""",
)
def token_store_fetch(spark, d):
    """Records fetched by source and row number: every row that the given stores index is asked of a newly written one."""
    path = scratch_path(spark, "tokens")
    writers.token_store(owned_rows(spark, d).select("source", "digest", "norm"), path)
    wanted = table(spark, d, "token_store_index").where("split = 'train' AND source IS NOT NULL").select("source", "row_index").distinct()
    weighted = F.aggregate(F.zip_with("tokens", F.sequence(F.lit(1), F.size("tokens")), lambda t, p: (t * p).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    checksum = F.when(F.size("tokens") > 0, weighted)
    stored = spark.read.parquet(path).select("source", "row_index", "length", F.lower(F.hex("digest")).alias("digest"), checksum.alias("checksum"))
    return wanted.join(stored, ["source", "row_index"])


@query("jsonl_log", "SELECT evaluation_sha256, training_sha256, pident, alnlen, evalue, bits, count(*) AS times FROM homology_hits GROUP BY ALL")
def jsonl_log(spark, d):
    """The hits appended to a JSON-lines log in two goes, and read with a given schema; nulls and repeated lines survive."""
    columns = ["evaluation_sha256", "training_sha256", "pident", "alnlen", "evalue", "bits"]
    rows, path = table(spark, d, "homology_hits").select(*columns), scratch_path(spark, "log")
    half = F.pmod(F.xxhash64(*columns), F.lit(2))
    for part in (0, 1):
        writers.append_log(rows.where(half == part), path)
    schema = "evaluation_sha256 string, training_sha256 string, pident double, alnlen int, evalue double, bits double"
    return readers.json_lines(spark, path, schema).groupBy(*columns).agg(F.count("*").alias("times"))


@query("json_array_document", "SELECT name, context_length, micro_batch_size, gradient_accumulation, budget_residues, mixture['uniref90'] AS uniref90 FROM stages")
def json_array_document(spark, d):
    """The stages as one JSON array, written and read."""
    path = scratch_path(spark, "array")
    writers.json_array(table(spark, d, "stages"), path)
    rows = readers.json_array(spark, path, "name string, context_length int, micro_batch_size int, gradient_accumulation int, budget_residues bigint, mixture map<string, double>")
    return rows.select("name", "context_length", "micro_batch_size", "gradient_accumulation", "budget_residues", F.try_element_at("mixture", F.lit("uniref90")).alias("uniref90"))


@query("id_list_order", "SELECT row_number() OVER (ORDER BY chain_id) - 1 AS ordinal, chain_id AS id FROM (SELECT DISTINCT chain_id FROM cached_contact_chain WHERE chain_id IS NOT NULL)")
def id_list_order(spark, d):
    """The chains as an id list over several files; the order of the lines is the order of the population."""
    path = scratch_path(spark, "ids")
    writers.id_list(table(spark, d, "cached_contact_chain").select("chain_id").distinct(), "chain_id", path)
    return readers.id_list(spark, path)


@query("fasta_write_read", f"WITH {RECORDS} SELECT record_id::VARCHAR AS name, norm AS sequence FROM r WHERE norm IS NOT NULL")
def fasta_write_read(spark, d):
    """All records as FASTA text, written and parsed in parallel."""
    path = scratch_path(spark, "fasta")
    writers.fasta(corpus.records(table(spark, d, "released_sequences")).select(F.col("record_id").alias("name"), F.col("norm").alias("sequence")), path)
    return readers.fasta(spark, path).select("name", "sequence")


_LINES = f"lines AS (SELECT DISTINCT split, evaluation_id, evaluation_id || ':' || sha256({norm('sequence')}) AS line FROM evaluation_sequences WHERE sequence IS NOT NULL AND split IS NOT NULL)"


@query(
    "payload_inventory",
    f"WITH {_LINES} SELECT split AS name, sha256(string_agg(line || chr(10), '' ORDER BY evaluation_id, line)) AS sha256, true AS bound FROM lines GROUP BY split UNION ALL SELECT 'absent', NULL, false",
)
def payload_inventory(spark, d):
    """Payload files (a list of record digests per evaluation split) against an inventory of declared digests.

    The inventory is computed from the table, and names one file that isn't there.
    """
    norm_ = normalised(F.col("sequence"))
    rows = table(spark, d, "evaluation_sequences").where("sequence IS NOT NULL AND split IS NOT NULL").select("split", "evaluation_id", F.concat_ws(":", F.col("evaluation_id").cast("string"), F.sha2(norm_, 256)).alias("line")).distinct()
    rows, path = settle(rows, "payload-lines"), scratch_path(spark, "payloads")
    writers.payloads(rows, "split", ["evaluation_id", "line"], "line", path)
    # the protected set is of a fixed size
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("evaluation_id", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    inventory = rows.groupBy(F.col("split").alias("name")).agg(F.sha2(listed, 256).alias("declared"))
    inventory = inventory.unionByName(inventory.limit(1).select(F.lit("absent").alias("name"), F.lit("0" * 64).alias("declared")))
    files = readers.payloads(spark, f"{path}/*/*.txt").withColumn("name", F.regexp_extract("path", "split=([^/]*)/", 1))
    return readers.bound_payloads(files, inventory).select("name", "sha256", "bound")


@query(
    "contact_cache_write_read",
    f"""WITH {_PAIRS}, z AS (SELECT chain, count(*) AS n_pairs, count(*) FILTER (contact) AS contacts, count(*) FILTER (score <= 1) AS valid, ceil(count(*) / 8)::BIGINT AS bytes FROM pr GROUP BY chain)
    SELECT chain, n_pairs, valid, contacts, (sum(2 * bytes) OVER (ORDER BY chain) - 2 * bytes)::BIGINT AS valid_offset, (sum(2 * bytes) OVER (ORDER BY chain) - bytes)::BIGINT AS contact_offset, bytes AS contact_bytes, true AS intact FROM z""",
)
def contact_cache_write_read(spark, d):
    """Bit masks of resolved and touching pairs per chain, written with offsets, read back and counted.

    ``intact``: the entries log and the masks agree, and the offsets leave no gap.
    """
    pairs = settle(_pairs(spark, d), "cache-pairs").withColumn("resolved", F.col("score") <= 1)
    masks = contacts.packed_flags(pairs, "resolved").withColumnRenamed("bits", "v").join(contacts.packed_flags(pairs, "contact").select("chain", F.col("bits").alias("c")), "chain")
    path = scratch_path(spark, "contact-cache")
    writers.contact_cache(masks.select("chain", "n_pairs", F.unhex("v").alias("valid"), F.unhex("c").alias("contact")), path)
    schema = "chain bigint, n_pairs bigint, valid_offset bigint, valid_bytes bigint, contact_offset bigint, contact_bytes bigint"
    entries = readers.json_lines(spark, f"{path}/entries", schema)
    stored = spark.read.parquet(f"{path}/masks")
    ones = lambda c: F.size(F.filter(readers.packed_bits(c, "n_pairs"), lambda x: x)).cast("bigint")
    counted = stored.select("chain", "n_pairs", ones("valid").alias("valid"), ones("contact").alias("contacts"), F.length("contact").cast("bigint").alias("held"))
    both = entries.join(counted, ["chain", "n_pairs"], "full_outer")
    intact = (F.col("contact_bytes") == F.col("held")) & (F.col("contact_offset") == F.col("valid_offset") + F.col("valid_bytes"))
    return both.select("chain", "n_pairs", "valid", "contacts", "valid_offset", "contact_offset", "contact_bytes", F.coalesce(intact, F.lit(False)).alias("intact"))


_UNITS = f"ev AS (SELECT evaluation_id, norm, sha256(norm) AS digest FROM (SELECT evaluation_id, min({norm('sequence')}) AS norm FROM evaluation_sequences WHERE sequence IS NOT NULL AND evaluation_id IS NOT NULL GROUP BY 1))"


@query(
    "mask_cache_write_read",
    f"""WITH {_UNITS}, {mask_sql('ev', str(20260821), 'evaluation_id')},
    x AS (SELECT evaluation_id, targets, list_transform(regexp_extract_all(crop, '.'), lambda c: instr('{LETTERS}', c) + 3) AS ids FROM m)
    SELECT evaluation_id, len(ids)::BIGINT AS n_tokens, len(targets)::BIGINT AS n_targets,
           coalesce(list_sum(list_transform(ids, lambda t, i: i * CASE WHEN list_contains(targets, i) THEN 32 ELSE t END)), 0)::BIGINT AS token_checksum,
           coalesce(list_sum(list_transform(ids, lambda t, i: i * CASE WHEN list_contains(targets, i) THEN t ELSE -100 END)), 0)::BIGINT AS label_checksum FROM x""",
)
def mask_cache_write_read(spark, d):
    """The masked examples of the evaluation records: corrupted tokens and labels, written once, read back."""
    units = table(spark, d, "evaluation_sequences").where("sequence IS NOT NULL AND evaluation_id IS NOT NULL").groupBy("evaluation_id").agg(F.min(normalised(F.col("sequence"))).alias("norm"))
    rows = masking.corrupted(masking.masked(units.withColumn("digest", F.sha2("norm", 256)), 20260821))
    path = scratch_path(spark, "mask-cache")
    writers.mask_cache(rows.withColumnRenamed("evaluation_id", "unit"), path)
    weighted = lambda c: F.aggregate(F.transform(c, lambda t, i: (t * (i + 1)).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    stored = spark.read.parquet(path)
    targets = F.size(F.filter("labels", lambda x: x != masking.IGNORED)).cast("bigint")
    return stored.select(F.col("unit").alias("evaluation_id"), F.size("tokens").cast("bigint").alias("n_tokens"), targets.alias("n_targets"), weighted("tokens").alias("token_checksum"), weighted("labels").alias("label_checksum"))


def _planned_sql(samples: int, name: str) -> str:
    return f"""{name} AS (SELECT s.source, shard, records, residues, ceil(round({samples} * (weight / 101.0)::DOUBLE, 9))::BIGINT AS required, (sum(records) OVER (PARTITION BY s.source ORDER BY shard) - records)::BIGINT AS records_before
      FROM shards s JOIN (SELECT * FROM (VALUES ('uniref90', 36.0), ('mgnify', 11.0), ('omg_img', 54.0)) v(source, weight)) w ON w.source = s.source)"""


@query(
    "plan_totals",
    f"""{packed_sql(SHARD_CAP)}, {_planned_sql(3000, 'p')}, k AS (SELECT * FROM p WHERE records_before < required)
    SELECT coalesce(source, '(all)') AS source, count(*) AS shards, sum(records)::BIGINT AS records, sum(residues)::BIGINT AS residues, (sum(residues) + 44 * sum(records))::BIGINT AS store_bytes FROM k GROUP BY ROLLUP (source)""",
)
def plan_totals(spark, d):
    """What a plan will store, per source and in total."""
    shards = settle(planning.pack_shards(owned_rows(spark, d).select("source", "digest", "length"), SHARD_CAP), "shards")
    planned = planning.plan_by_samples(shards, PLAN_WEIGHTS, 3000).select("source", "shard").join(shards, ["source", "shard"])
    rolled = planned.rollup("source").agg(F.count("*").alias("shards"), F.sum("records").alias("records"), F.sum("residues").alias("residues"))
    return rolled.select(F.coalesce("source", F.lit("(all)")).alias("source"), "shards", "records", "residues", (F.col("residues") + planning.RECORD_BYTES * F.col("records")).alias("store_bytes"))


@query(
    "plan_materialised",
    f"""{packed_sql(SHARD_CAP)}, {_planned_sql(3000, 'p')}, k AS (SELECT * FROM p WHERE records_before < required)
    SELECT source, count(*) AS shards, sum(records)::BIGINT AS planned_records, sum(records)::BIGINT AS stored_records, sum(residues)::BIGINT AS stored_residues, true AS closed, true AS prefix, true AS verified FROM k GROUP BY source""",
)
def plan_materialised(spark, d):
    """A plan carried out: its shards are read from the written release and stored as tokens; the receipt is then held against plan and manifest.

    ``prefix``: the planned shards are the first of the manifest, in order and with its counts.
    """
    _, shards, root = release_files(spark, d)
    plan = settle(planning.plan_by_samples(shards, PLAN_WEIGHTS, 3000).select("source", "shard", "records"), "plan")
    manifest = readers.release_manifest(spark, f"{root}/manifest").select("source", F.col("ordinal").cast("bigint").alias("shard"), "path", F.col("records").alias("declared"), "residues")
    chosen = settle(plan.join(manifest, ["source", "shard"], "left"), "chosen")
    # one path per planned shard
    files = [r["path"] for r in chosen.where("path IS NOT NULL").select("path").collect()]
    rows = readers.pinned(spark, f"{root}/data", files, f"{readers.RECORD}, source string, shard bigint")
    receipt = writers.token_store(rows.select("source", F.col("sha256").alias("digest"), F.col("sequence").alias("norm")), f"{root}/tokens")
    planned = chosen.groupBy("source").agg(F.count("*").alias("shards"), F.sum("records").alias("planned_records"), F.sum("residues").alias("planned_residues"), ((F.max("shard") + 1 == F.count("*")) & F.bool_and(F.col("records").eqNullSafe(F.col("declared")))).alias("prefix"))
    both = planned.join(receipt, "source", "full_outer")
    verified = F.col("prefix") & F.col("closed") & (F.col("planned_records") == F.col("records")) & (F.col("planned_residues") == F.col("residues"))
    return both.select("source", "shards", "planned_records", F.col("records").alias("stored_records"), F.col("residues").alias("stored_residues"), "closed", "prefix", F.coalesce(verified, F.lit(False)).alias("verified"))


@query(
    "plan_reuse",
    f"""{packed_sql(SHARD_CAP)}, {_planned_sql(1000, 'p1')}, {_planned_sql(3000, 'p3')}, a AS (SELECT source, count(*) AS n FROM p1 WHERE records_before < required GROUP BY 1), b AS (SELECT source, count(*) AS n FROM p3 WHERE records_before < required GROUP BY 1)
    SELECT source, coalesce(a.n, 0) AS old_shards, coalesce(b.n, 0) AS new_shards, CASE WHEN a.n = b.n THEN 'reuse' ELSE 'write' END AS action FROM a FULL JOIN b USING (source)""",
)
def plan_reuse(spark, d):
    """Which sources of a larger plan can keep the store of a smaller one."""
    shards = settle(planning.pack_shards(owned_rows(spark, d).select("source", "digest", "length"), SHARD_CAP), "shards")
    return planning.reusable_sources(*[planning.plan_by_samples(shards, PLAN_WEIGHTS, n) for n in (1000, 3000)])


_LATE = f"CASE WHEN coalesce(ingested_at <= TIMESTAMP '{CUT}', false) THEN 0 ELSE 1 END"


@query(
    "expanded_store_prefix",
    f"""WITH {RECORDS} SELECT source, count(*) AS new_rows, count(*) FILTER ({_LATE} = 0) AS old_rows, count(*) FILTER ({_LATE} = 1) AS appended, 0::BIGINT AS different FROM r
    WHERE split = 'train' AND source IS NOT NULL AND norm IS NOT NULL GROUP BY source""",
)
def expanded_store_prefix(spark, d):
    """A store of the earlier records, and an expanded one with late records appended: the old one must be its prefix.

    Both are written, read back and compared row by row; late records come in any order of their time.
    """
    late = 1 - F.coalesce((F.col("ingested_at") <= F.lit(CUT).cast("timestamp_ntz")).cast("int"), F.lit(0))
    when = table(spark, d, "released_sequences").where("split = 'train'").select("record_id", "ingested_at").dropDuplicates(["record_id"])
    rows = corpus.records(table(spark, d, "released_sequences"), "train").where("source IS NOT NULL AND norm IS NOT NULL").select("record_id", "source", "digest").join(when, "record_id").withColumn("late", late)
    rows = settle(rows, "expansion-rows")

    def store(part: DataFrame) -> DataFrame:
        return settle(ranked(part, ["source"], ["late", "record_id"]).select("source", "rn", "digest", "late"), "expansion-store")

    old, new = store(rows.where("late = 0")), store(rows)
    both = new.join(old.select("source", "rn", F.col("digest").alias("before")), ["source", "rn"], "full_outer")
    return both.groupBy("source").agg(F.count("digest").alias("new_rows"), F.count("before").alias("old_rows"), F.count_if(F.col("before").isNull()).alias("appended"), F.count_if(F.col("before").isNotNull() & ~F.col("before").eqNullSafe(F.col("digest"))).alias("different"))


@query(
    "strict_merge",
    """WITH c AS (SELECT chain_id, row_number() OVER (ORDER BY chain_id) - 1 AS position FROM (SELECT DISTINCT chain_id FROM cached_contact_chain WHERE chain_id IS NOT NULL))
    SELECT 'whole' AS delivery, count(*) AS expected, count(*) AS once, 0 AS missing, 0 AS repeated, 0 AS unknown, 0 AS misplaced FROM c
    UNION ALL SELECT 'damaged', count(*), count(*) FILTER (position % 10 <> 3 AND position % 4 <> 2), count(*) FILTER (position % 10 = 3), count(*) FILTER (position % 10 <> 3 AND position % 4 = 2), 1, count(*) FILTER (position % 10 = 7) FROM c""",
)
def strict_merge(spark, d):
    """Outputs of 4 workers over all chains, written and merged strictly: once as dealt, once damaged.

    In the damaged delivery worker 2 delivers twice, every tenth unit is lost, another tenth comes from the wrong worker, and
    one unit is unknown.
    """
    chains = ranked(table(spark, d, "cached_contact_chain").where("chain_id IS NOT NULL").select("chain_id").distinct(), [], ["chain_id"]).select("chain_id", (F.col("rn") - 1).alias("position"))
    chains = settle(chains, "population").withColumn("worker", F.pmod("position", F.lit(4)).cast("int"))
    wrong = F.when(F.col("position") % 10 == 7, F.pmod(F.col("worker") + 1, F.lit(4))).otherwise(F.col("worker"))
    kept = chains.where("position % 10 <> 3").withColumn("from", F.col("worker")).withColumn("worker", wrong)
    stranger = chains.where("position = 0").select(F.lit("no such chain").alias("chain_id"), "position", "worker")
    damaged = kept.drop("from").unionByName(kept.where("`from` = 2").drop("from")).unionByName(stranger)
    out = None
    for name, parts in (("whole", chains), ("damaged", damaged)):
        path = scratch_path(spark, f"parts-{name}")
        parts.select("worker", "chain_id", "position").write.partitionBy("worker").parquet(path)
        read = spark.read.schema("worker int, chain_id string, position bigint").parquet(path)
        row = reports.strict_merge(read, chains, "chain_id", 4).select(F.lit(name).alias("delivery"), "*")
        out = row if out is None else out.unionByName(row)
    return out
