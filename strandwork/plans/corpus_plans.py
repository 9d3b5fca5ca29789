"""Queries over the release: normalisation, funnel, protection, manifests, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequence import framed, token_ids
from strandwork.operators import corpus, masking, planning
from strandwork.operators.ordering import ranked
from strandwork.plans.registry import query
from strandwork.plans.sql import HITS, LETTERS, PROTECTED, RECORDS
from strandwork.runtime import table


def _released(spark, d) -> DataFrame:
    return table(spark, d, "released_sequences")


@query("seq_normalize", f"WITH {RECORDS} SELECT record_id, length(norm) AS norm_length, digest FROM r")
def seq_normalize(spark, d):
    return corpus.records(_released(spark, d)).select("record_id", "norm_length", "digest")


@query(
    "quality_ledger",
    f"""WITH {RECORDS}, t AS (SELECT coalesce(source, '(none)') AS source, coalesce(rejected, 'eligible') AS reason FROM r)
    SELECT coalesce(source, '(all)') AS source, count(*) AS records, {", ".join(f"count(*) FILTER (reason = '{k}') AS {k if k != 'long' else '"long"'}" for k in ["missing", "short", "long", "ambiguous", "eligible"])}
    FROM t GROUP BY ROLLUP (source)""",
)
def quality_ledger(spark, d):
    return corpus.quality_ledger(corpus.records(_released(spark, d)))


_FUNNEL = f"""WITH {RECORDS}, {PROTECTED}, {HITS},
owner AS (SELECT digest, record_id FROM (SELECT digest, record_id, row_number() OVER (PARTITION BY digest ORDER BY arm, coalesce(source, ''), record_id) AS rn FROM r WHERE split = 'train' AND rejected IS NULL) WHERE rn = 1),
f AS (
  SELECT r.record_id, coalesce(r.source, '(none)') AS source, length(norm) AS n,
    CASE WHEN rejected IS NOT NULL THEN rejected WHEN o.record_id <> r.record_id THEN 'duplicate'
         WHEN r.digest IN (SELECT digest FROM guarded) THEN 'protected_exact'
         WHEN sha IN (SELECT training_digest FROM hits WHERE training_digest IS NOT NULL) THEN 'protected_homology'
         WHEN r.digest IN (SELECT digest FROM r WHERE split = 'validation' AND digest IS NOT NULL) THEN 'validation' ELSE 'kept' END AS reason
  FROM r LEFT JOIN owner o ON o.digest = r.digest WHERE split = 'train')"""


@query(
    "corpus_funnel",
    f"{_FUNNEL} SELECT source, reason, count(*) AS records, coalesce(sum(n), 0)::BIGINT AS residues FROM (SELECT * FROM f UNION ALL SELECT record_id, '(all)', n, reason FROM f) GROUP BY source, reason",
)
def corpus_funnel(spark, d):
    return corpus.funnel_ledger(_released(spark, d), table(spark, d, "evaluation_sequences"), table(spark, d, "homology_hits"))


@query("train_records_kept", f"{_FUNNEL} SELECT record_id, source, n AS norm_length FROM f WHERE reason = 'kept'")
def train_records_kept(spark, d):
    rows = corpus.funnel(_released(spark, d), table(spark, d, "evaluation_sequences"), table(spark, d, "homology_hits"))
    return rows.where("reason = 'kept'").select("record_id", F.coalesce("source", F.lit("(none)")).alias("source"), "norm_length")


@query(
    "exact_dedup_owner",
    f"""WITH {RECORDS}, e AS (SELECT *, row_number() OVER (PARTITION BY digest ORDER BY arm, coalesce(source, ''), record_id) AS rn FROM r WHERE rejected IS NULL)
    SELECT digest, max(record_id) FILTER (rn = 1) AS owner_id, max(source) FILTER (rn = 1) AS owner_source, count(*) AS copies, count(DISTINCT coalesce(source, '(none)')) AS sources FROM e GROUP BY digest""",
)
def exact_dedup_owner(spark, d):
    return corpus.owners(corpus.records(_released(spark, d)))


@query(
    "cross_source_membership",
    f"""WITH {RECORDS}, p AS (SELECT digest, string_agg(DISTINCT coalesce(source, '(none)'), '+' ORDER BY coalesce(source, '(none)')) AS sources, count(*) AS n FROM r WHERE digest IS NOT NULL GROUP BY digest)
    SELECT sources, count(*) AS digests, sum(n)::BIGINT AS records FROM p GROUP BY sources""",
)
def cross_source_membership(spark, d):
    return corpus.memberships(corpus.records(_released(spark, d)))


@query("protected_exact", f"WITH {RECORDS}, {PROTECTED} SELECT record_id, source, digest FROM r WHERE split = 'train' AND digest IN (SELECT digest FROM guarded)")
def protected_exact(spark, d):
    rows = corpus.records(_released(spark, d), "train").select("record_id", "source", "digest")
    return rows.join(corpus.protected_digests(table(spark, d, "evaluation_sequences")), "digest", "left_semi")


@query("homology_hits_passing", f"WITH {HITS} SELECT * FROM hits")
def homology_hits_passing(spark, d):
    return corpus.clean_hits(table(spark, d, "homology_hits"))


@query(
    "protected_homology",
    f"""WITH {RECORDS}, {HITS} SELECT coalesce(source, '(none)') AS source, count(*) AS records, count(*) FILTER (sha IN (SELECT training_digest FROM hits WHERE training_digest IS NOT NULL)) AS excluded
    FROM r WHERE split = 'train' GROUP BY 1""",
)
def protected_homology(spark, d):
    hit = corpus.clean_hits(table(spark, d, "homology_hits")).select(F.col("training_digest").alias("sha")).where("sha IS NOT NULL").distinct().withColumn("hit", F.lit(True))
    rows = corpus.records(_released(spark, d), "train").select("source", "sha").join(hit, "sha", "left")
    return rows.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("records"), F.count_if("hit").alias("excluded"))


@query(
    "accession_classes",
    """SELECT CASE WHEN accession IS NULL THEN 'missing' WHEN regexp_matches(accession, '^([0-9]{7,}|Ga|IMG|JGI)') THEN 'img'
        WHEN regexp_matches(accession, '^(ERZ|ERR|ERS|ERP|MGY)') THEN 'mgnify_origin' ELSE 'unclassified' END AS class, doc_kind, count(*) AS documents FROM documents GROUP BY ALL""",
)
def accession_classes(spark, d):
    return table(spark, d, "documents").groupBy(corpus.accession_class(F.col("accession")).alias("class"), "doc_kind").agg(F.count("*").alias("documents"))


VALIDATION_SIZE = 4096


@query(
    "validation_first_4096",
    f"""WITH {RECORDS}, {PROTECTED}, {HITS},
    v AS (SELECT source, digest, record_id, sha FROM r WHERE split = 'validation' AND rejected IS NULL QUALIFY row_number() OVER (PARTITION BY digest ORDER BY arm, coalesce(source, ''), record_id) = 1)
    SELECT source, row_number() OVER (PARTITION BY source ORDER BY digest) AS rn, digest, record_id FROM v
    WHERE source IS NOT NULL AND NOT EXISTS (FROM guarded g WHERE g.digest = v.digest) AND NOT EXISTS (FROM hits h WHERE h.training_digest = v.sha) QUALIFY rn <= {VALIDATION_SIZE}""",
)
def validation_first_4096(spark, d):
    """The validation records of the release: all that are eligible, up to the published number of each source."""
    return corpus.validation_set(_released(spark, d), table(spark, d, "evaluation_sequences"), table(spark, d, "homology_hits"), VALIDATION_SIZE)


@query(
    "split_disjoint",
    f"""WITH {RECORDS}, {PROTECTED}, p AS (SELECT digest, split AS part FROM r WHERE digest IS NOT NULL UNION ALL SELECT digest, 'protected' FROM guarded),
    b AS (SELECT digest, bool_or(part = 'train') AS t, bool_or(part = 'validation') AS v, bool_or(part = 'protected') AS p FROM p GROUP BY digest)
    SELECT count(*) FILTER (t) AS train, count(*) FILTER (v) AS validation, count(*) FILTER (p) AS protected, count(*) FILTER (t AND v) AS train_validation,
           count(*) FILTER (t AND p) AS train_protected, count(*) FILTER (v AND p) AS validation_protected FROM b""",
)
def split_disjoint(spark, d):
    return corpus.overlaps_of_splits(_released(spark, d), table(spark, d, "evaluation_sequences"))


_IDS = f"list_transform(regexp_extract_all(norm, '.'), lambda c: instr('{LETTERS}', c) + 3)"


def _checksum(ids):
    return F.aggregate(F.zip_with(ids, F.sequence(F.lit(1), F.size(ids)), lambda t, p: (t * p).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


@query("token_encode", f"WITH {RECORDS}, x AS (SELECT record_id, {_IDS} AS ids FROM r WHERE length(norm) > 0) SELECT record_id, len(ids) AS n_tokens, list_sum(list_transform(ids, lambda t, i: t * i))::BIGINT AS checksum FROM x")
def token_encode(spark, d):
    rows = corpus.records(_released(spark, d)).where("norm_length > 0").select("record_id", token_ids(F.col("norm")).alias("ids"))
    return rows.select("record_id", F.size("ids").alias("n_tokens"), _checksum(F.col("ids")).alias("checksum"))


@query(
    "token_histogram",
    f"WITH {RECORDS} SELECT source, instr('{LETTERS}', c) + 3 AS token_id, count(*) AS n FROM (SELECT source, unnest(regexp_extract_all(norm, '.')) AS c FROM r WHERE norm IS NOT NULL) GROUP BY ALL",
)
def token_histogram(spark, d):
    return masking.token_histogram(corpus.records(_released(spark, d)).where("norm IS NOT NULL"))


@query(
    "encode_pad_batch",
    f"""WITH {RECORDS}, x AS (SELECT record_id, {_IDS} AS ids FROM r WHERE norm IS NOT NULL),
    y AS (SELECT record_id, list_concat(list_concat([0], ids[4:129]), [2]) AS body FROM x)
    SELECT record_id, 128 AS width, 128 - len(body) AS padding, list_sum(list_transform(body, lambda t, i: t * i))::BIGINT + coalesce(list_sum(range(len(body) + 1, 129)), 0)::BIGINT AS checksum FROM y""",
)
def encode_pad_batch(spark, d):
    """Framed to 128 ids, cropped from offset 3; a pad id is 1, so padding adds its positions."""
    rows = corpus.records(_released(spark, d)).where("norm IS NOT NULL").select("record_id", framed(token_ids(F.col("norm")), 128, 3).alias("ids"))
    return rows.select("record_id", F.size("ids").alias("width"), F.size(F.filter("ids", lambda t: t == 1)).alias("padding"), _checksum(F.col("ids")).alias("checksum"))


_STORE = "t AS (SELECT DISTINCT store, row_index, token_offset, length, digest FROM token_store_index)"


@query(
    "store_offsets",
    f"""WITH {_STORE}, o AS (SELECT *, sum(length) OVER (PARTITION BY store ORDER BY row_index) - length AS expected FROM t)
    SELECT store, count(*) AS rows, count(*) FILTER (expected <> token_offset) AS wrong_offsets, sum(length)::BIGINT AS residues FROM o GROUP BY store""",
)
def store_offsets(spark, d):
    rows = table(spark, d, "token_store_index").select("store", "row_index", "token_offset", "length").distinct()
    placed = ranked(rows, ["store"], ["row_index"], "length")
    return placed.groupBy("store").agg(F.count("*").alias("rows"), F.count_if(F.col("before") != F.col("token_offset")).alias("wrong_offsets"), F.sum("length").alias("residues"))


@query(
    "store_extent",
    f"WITH {_STORE} SELECT store, max(token_offset + length) AS extent, sum(length)::BIGINT AS residues, max(row_index) + 1 = count(*) AS dense, max(token_offset + length) = sum(length) AS closed FROM t GROUP BY store",
)
def store_extent(spark, d):
    rows = table(spark, d, "token_store_index").select("store", "row_index", "token_offset", "length").distinct()
    end = F.max(F.col("token_offset") + F.col("length"))
    return rows.groupBy("store").agg(end.alias("extent"), F.sum("length").alias("residues"), (F.max("row_index") + 1 == F.count("*")).alias("dense"), (end == F.sum("length")).alias("closed"))


@query(
    "store_digests",
    f"""WITH {RECORDS}, {_STORE}, known AS (SELECT DISTINCT digest FROM r WHERE digest IS NOT NULL), p AS (SELECT store, rpad(lower(hex(digest)), 64, '0') AS digest FROM t)
    SELECT store, count(*) AS rows, count(*) FILTER (p.digest IS NULL) AS no_digest, count(k.digest) AS known, count(*) FILTER (p.digest IS NOT NULL AND k.digest IS NULL) AS unknown
    FROM p LEFT JOIN known k ON k.digest = p.digest GROUP BY store""",
)
def store_digests(spark, d):
    """Stored digests (trailing zero bytes restored) against those of the release's records."""
    known = corpus.records(_released(spark, d)).where("digest IS NOT NULL").select("digest").distinct().withColumn("known", F.lit(True))
    rows = table(spark, d, "token_store_index").select("store", "row_index", "token_offset", "length", "digest").distinct().select("store", F.rpad(F.lower(F.hex("digest")), 64, "0").alias("digest"))
    return rows.join(known, "digest", "left").groupBy("store").agg(F.count("*").alias("rows"), F.count_if(F.col("digest").isNull()).alias("no_digest"), F.count("known").alias("known"), F.count_if(F.col("digest").isNotNull() & F.col("known").isNull()).alias("unknown"))


@query(
    "digest_order_check",
    f"""WITH {_STORE}, o AS (SELECT store, digest, lag(digest) OVER (PARTITION BY store ORDER BY row_index) AS prior FROM t WHERE digest IS NOT NULL)
    SELECT store, count(*) AS rows, count(*) FILTER (digest <= prior) AS disordered FROM o GROUP BY store""",
)
def digest_order_check(spark, d):
    """Digests must rise strictly along a store; the neighbour is found by rank, so no task holds a store."""
    rows = table(spark, d, "token_store_index").where("digest IS NOT NULL").select("store", "row_index", "digest").distinct()
    placed = ranked(rows, ["store"], ["row_index"])
    prior = placed.select("store", (F.col("rn") + 1).alias("rn"), F.col("digest").alias("prior"))
    return placed.join(prior, ["store", "rn"], "left").groupBy("store").agg(F.count("*").alias("rows"), F.count_if(F.col("digest") <= F.col("prior")).alias("disordered"))


@query(
    "shard_manifest_check",
    f"""WITH {RECORDS} SELECT path, count(*) AS records, coalesce(sum(length(norm)), 0)::BIGINT AS residues, min(digest) AS least_digest, max(digest) AS greatest_digest,
    count(*) FILTER (length IS NULL) AS no_length, count(*) FILTER (length <> length(norm)) AS wrong_length, count(*) FILTER (sha IS NULL) AS no_digest, count(*) FILTER (sha <> digest) AS wrong_digest FROM r GROUP BY path""",
)
def shard_manifest_check(spark, d):
    return planning.manifest(corpus.records(_released(spark, d)))


@query(
    "release_constraints",
    f"""WITH {RECORDS}, raw AS (SELECT count(*) AS n FROM released_sequences)
    SELECT (SELECT n FROM raw) - count(*) AS repeated_rows, count(*) FILTER (split NOT IN ('train', 'validation')) AS other_splits, count(*) FILTER (sha IS NOT NULL AND NOT regexp_full_match(sha, '[0-9a-f]{{64}}')) AS bad_digests,
           count(*) FILTER (path LIKE '/%' OR path LIKE '%..%') AS unsafe_paths, count(*) FILTER (length(norm) NOT BETWEEN 32 AND 16384) AS outside_storage_lengths,
           count(*) FILTER (source IS NOT NULL AND NOT starts_with(path, source || '/' || split || '/')) AS misplaced FROM r""",
)
def release_constraints(spark, d):
    """Counts of broken release rules; all zero for a sound release."""
    rows = corpus.records(_released(spark, d))
    total = _released(spark, d).agg(F.count("*").alias("n"))
    found = rows.agg(
        F.count("*").alias("records"),
        F.count_if(~F.col("split").isin("train", "validation")).alias("other_splits"),
        F.count_if(~F.col("sha").rlike("^[0-9a-f]{64}$")).alias("bad_digests"),
        F.count_if(F.col("path").startswith("/") | F.col("path").contains("..")).alias("unsafe_paths"),
        F.count_if(~F.col("norm_length").between(32, 16384)).alias("outside_storage_lengths"),
        F.count_if(~F.col("path").startswith(F.concat("source", F.lit("/"), "split", F.lit("/")))).alias("misplaced"),
    )
    return total.join(found).select((F.col("n") - F.col("records")).alias("repeated_rows"), "other_splits", "bad_digests", "unsafe_paths", "outside_storage_lengths", "misplaced")


_OWNED = "owned AS (SELECT source, digest, max(length(norm)) AS length FROM r WHERE split = 'train' AND source IS NOT NULL AND digest IS NOT NULL GROUP BY 1, 2)"


def packed_sql(cap: int) -> str:
    """Shards by walking from each start to the next (a recursive query)."""
    return f"""WITH RECURSIVE {RECORDS}, {_OWNED},
    c AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, sum(length) OVER w - length AS before FROM owned WINDOW w AS (PARTITION BY source ORDER BY digest)),
    starts AS (SELECT source, 1::BIGINT AS rn, 0::HUGEINT AS before FROM c WHERE rn = 1
      UNION ALL SELECT s.source, min(c.rn), min(c.before) FROM starts s JOIN c ON c.source = s.source AND c.rn > s.rn AND c.before + c.length > s.before + {cap} GROUP BY s.source),
    ends AS (SELECT source, rn, row_number() OVER (PARTITION BY source ORDER BY rn) - 1 AS shard, coalesce(lead(rn) OVER (PARTITION BY source ORDER BY rn) - 1, 9223372036854775807) AS last FROM starts),
    shards AS (SELECT e.source, shard, count(*) AS records, sum(length)::BIGINT AS residues, min(digest) AS least_digest, max(digest) AS greatest_digest FROM ends e JOIN c ON c.source = e.source AND c.rn BETWEEN e.rn AND e.last GROUP BY 1, 2)"""


SHARD_CAP = 50_000
#: Weights of a two-arm and a three-arm plan.
PLAN_WEIGHTS = {"uniref90": 36.0, "mgnify": 11.0, "omg_img": 54.0}


def packed(spark, d) -> DataFrame:
    rows = corpus.records(_released(spark, d), "train").where("source IS NOT NULL AND digest IS NOT NULL")
    return planning.pack_shards(rows.groupBy("source", "digest").agg(F.max("norm_length").alias("length")), SHARD_CAP)


@query("shard_pack", f"{packed_sql(SHARD_CAP)} SELECT * FROM shards")
def shard_pack(spark, d):
    return packed(spark, d)


@query(
    "plan_by_samples",
    f"""{packed_sql(SHARD_CAP)}, w AS (SELECT * FROM (VALUES ('uniref90', 36.0, 0), ('mgnify', 11.0, 1), ('omg_img', 54.0, 2)) v(source, weight, place)),
    p AS (SELECT s.source, shard, records, ceil(round(3000 * (weight / 101.0)::DOUBLE, 9))::BIGINT AS required, (sum(records) OVER (PARTITION BY s.source ORDER BY shard) - records)::BIGINT AS records_before, sum(records) OVER (PARTITION BY s.source) AS held FROM shards s JOIN w ON w.source = s.source)
    SELECT source, shard, records, required, records_before, held < required AS short FROM p WHERE records_before < required""",
)
def plan_by_samples(spark, d):
    return planning.plan_by_samples(packed(spark, d), PLAN_WEIGHTS, 3000)


@query(
    "plan_by_shards",
    f"""{packed_sql(SHARD_CAP)}, w AS (SELECT * FROM (VALUES ('uniref90', 36.0, 0), ('mgnify', 11.0, 1), ('omg_img', 54.0, 2)) v(source, weight, place)),
    p AS (SELECT s.source, shard, records, place, (sum(records) OVER (PARTITION BY s.source ORDER BY shard) - records)::DOUBLE / (weight / 101.0)::DOUBLE AS covered FROM shards s JOIN w ON w.source = s.source)
    SELECT row_number() OVER (ORDER BY round(covered, 6), place, shard) AS pick, source, shard, records FROM p QUALIFY pick <= 12""",
)
def plan_by_shards(spark, d):
    return planning.plan_by_shards(packed(spark, d), PLAN_WEIGHTS, 12)


@query("storage_estimate", f"WITH {RECORDS} SELECT source, split, count(*) AS records, coalesce(sum(length(norm)), 0)::BIGINT AS residues, (coalesce(sum(length(norm)), 0) + count(*) * 44)::BIGINT AS store_bytes FROM r GROUP BY ALL")
def storage_estimate(spark, d):
    return planning.storage(corpus.records(_released(spark, d)))


@query(
    "data_coverage",
    f"""WITH {RECORDS}, w AS (SELECT DISTINCT name AS stage, e.key AS source, e.value AS weight, list_sum(list_filter(map_values(mixture), lambda v: v IS NOT NULL)) AS total, ceil(budget_residues / context_length) AS sequences
      FROM stages, unnest(map_entries(mixture)) AS u(e) WHERE e.value IS NOT NULL AND context_length > 0),
    q AS (SELECT stage, source, round(sequences * weight / total, 6) AS expected_draws FROM w WHERE total > 0),
    pol AS (SELECT stage, source, coalesce(bool_or(allow_resampling), false) AS allowed FROM global_rows GROUP BY 1, 2),
    g AS (SELECT *, coalesce((json_extract_string(origin, '$.prior'))::BIGINT, 0) AS prior, row_number() OVER (PARTITION BY stage, source ORDER BY saved_at DESC, seed DESC, epoch DESC, epoch_cursor DESC, size DESC) AS rn FROM global_rows),
    seen AS (SELECT stage, source, least(prior + epoch * size + epoch_cursor, size) AS u FROM g WHERE rn = 1),
    s AS (SELECT source, count(*) AS records FROM r WHERE split = 'train' GROUP BY 1),
    f AS (SELECT q.stage, q.source, expected_draws, (ceil(round(expected_draws * 1.01::DOUBLE / 4, 6)) * 4)::BIGINT AS required, coalesce(records, 0) AS available, least(coalesce(u, 0), coalesce(records, 0)) AS consumed, coalesce(allowed, false) AS allowed
      FROM q LEFT JOIN pol ON pol.stage = q.stage AND pol.source = q.source LEFT JOIN seen ON seen.stage = q.stage AND seen.source = q.source LEFT JOIN s ON s.source = q.source)
    SELECT *, available - consumed AS unused, round(expected_draws / nullif(available, 0), 6) AS exposures, available - consumed >= required AND available >= 4 AS sufficient, NOT (available - consumed >= required AND available >= 4) AND NOT allowed AS blocked FROM f""",
)
def data_coverage(spark, d):
    supply = _released(spark, d).where("split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL").groupBy("source").agg(F.countDistinct("record_id").alias("records"))
    return planning.coverage(table(spark, d, "stages"), table(spark, d, "global_rows"), supply)


_MIXTURES = "SELECT name, 'mixture.' || e.key AS key, round(e.value, 4)::VARCHAR AS value FROM stages, unnest(map_entries(mixture)) AS u(e)"


@query(
    "config_differences_all",
    f"""WITH kv AS (SELECT name, unnest(['context_length', 'micro_batch_size', 'gradient_accumulation', 'budget_residues']) AS key,
      unnest([context_length::VARCHAR, micro_batch_size::VARCHAR, gradient_accumulation::VARCHAR, budget_residues::VARCHAR]) AS value FROM stages UNION ALL {_MIXTURES})
    SELECT key, a.value AS old, b.value AS new FROM (SELECT key, value FROM kv WHERE name = 'base_512') a FULL JOIN (SELECT key, value FROM kv WHERE name = 'polish_512') b USING (key)
    WHERE a.value IS DISTINCT FROM b.value AND key <> 'budget_residues'""",
)
def config_differences_all(spark, d):
    """Settings in which two stages differ, but for the budget, over every source that either mixture names."""
    from strandwork.operators.contracts import config_differences as differences

    plain = ["context_length", "micro_batch_size", "gradient_accumulation", "budget_residues"]
    settings = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in plain]
    sources = F.transform(F.map_entries("mixture"), lambda e: F.struct(F.concat(F.lit("mixture."), e["key"]).alias("key"), F.round(e["value"], 4).cast("string").alias("value")))
    entries = F.concat(F.array(*settings), F.coalesce(sources, F.array()))
    kv = table(spark, d, "stages").select("name", F.explode(entries).alias("e")).select("name", "e.key", "e.value")
    return differences(kv.where("name = 'base_512'"), kv.where("name = 'polish_512'"), ["budget_residues"])
