"""Queries over rules, policies, states and sets: what must hold before data is used."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequence import normalised
from strandwork.operators import contacts, corpus, planning, reports, sampling
from strandwork.operators.contracts import config_differences
from strandwork.plans import corpus_plans  # noqa: F401  (its SQL is extended here)
from strandwork.plans.registry import SQL, query
from strandwork.plans.sampling_plans import BATCH, SEED, WEIGHTS, WORLD, _train
from strandwork.plans.sql import RECORDS, key, norm, u52
from strandwork.runtime import scratch_path, settle, table
from strandwork.sources import readers, writers

_MANIFEST = f"""{RECORDS}, m AS (
  SELECT source, split, path, count(*) AS records, coalesce(sum(length(norm)), 0) AS residues, min(sha) AS lo, max(sha) AS hi FROM r GROUP BY ALL),
x AS (SELECT *, lag(hi) OVER (PARTITION BY source, split ORDER BY path) AS previous, count(*) OVER (PARTITION BY path) AS times FROM m WHERE source IS NOT NULL),
y AS (SELECT x.*, splits FROM x JOIN (SELECT source, count(DISTINCT split) AS splits FROM m GROUP BY 1) s ON s.source = x.source)"""


def _rule(name: str, holds: str) -> str:
    return f"SELECT '{name}' AS rule, count(*) AS shards, count(*) FILTER (NOT coalesce({holds}, false)) AS violations FROM y"


@query(
    "manifest_rules",
    f"WITH {_MANIFEST} "
    + " UNION ALL ".join(
        _rule(*x)
        for x in [
            ("path_unique", "times = 1"),
            ("path_relative", "NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..')"),
            ("path_named", "starts_with(path, source || '/' || split || '/')"),
            ("holds_records", "records > 0 AND residues > 0"),
            ("digests_formed", "regexp_full_match(lo, '[0-9a-f]{64}') AND regexp_full_match(hi, '[0-9a-f]{64}')"),
            ("digests_rise", "lo <= hi AND (previous IS NULL OR lo > previous)"),
            ("both_splits", "splits = 2"),
        ]
    ),
)
def manifest_rules(spark, d):
    """The release's own shards as a manifest, by declared digests, against the rules of a release.

    Late shards don't follow the digest order, so the rule on rising digests reports them.
    """
    rows = corpus.records(table(spark, d, "released_sequences")).where("source IS NOT NULL")
    manifest = rows.groupBy("source", "split", "path").agg(F.count("*").alias("records"), F.coalesce(F.sum("norm_length"), F.lit(0)).alias("residues"), F.min("sha").alias("least_digest"), F.max("sha").alias("greatest_digest"))
    return planning.shard_rules(settle(manifest, "manifest"))


_COVERED = SQL["data_coverage"].replace("SELECT *, available - consumed AS unused", ", cov AS (SELECT *, available - consumed AS unused").rstrip() + ")"


@query(
    "strict_exhaustion",
    f"""{_COVERED}, asked AS (SELECT stage, source, ceil(round(expected_draws, 6))::BIGINT AS wanted, unused AS unseen, NOT allowed AS strict FROM cov), e AS (SELECT *, strict AND wanted > unseen AS exhausted FROM asked)
    SELECT *, bool_or(exhausted) OVER (PARTITION BY stage) AS refused, CASE WHEN bool_or(exhausted) OVER (PARTITION BY stage) THEN 0 ELSE wanted END AS granted FROM e""",
)
def strict_exhaustion(spark, d):
    """Which stages may begin to draw: all sources that can't be passed again are checked before any cursor moves."""
    return planning.strict_check(_coverage(spark, d))


def _coverage(spark, d) -> DataFrame:
    supply = table(spark, d, "released_sequences").where("split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL").groupBy("source").agg(F.countDistinct("record_id").alias("records"))
    return settle(planning.coverage(table(spark, d, "stages"), table(spark, d, "global_rows"), supply), "coverage")


@query(
    "coverage_policies",
    f"""{_COVERED}, p AS (SELECT unnest(['error', 'allow', 'per_source']) AS policy), c AS (SELECT stage, policy, count(*) AS sources, count(*) FILTER (NOT sufficient AND (policy <> 'per_source' OR NOT allowed)) AS insufficient FROM cov, p GROUP BY ALL)
    SELECT *, CASE WHEN insufficient > 0 THEN 'insufficient' ELSE 'passed' END AS status, insufficient > 0 AND policy <> 'allow' AS refused FROM c""",
)
def coverage_policies(spark, d):
    """The outcome of each resampling policy per stage."""
    return planning.policy_outcomes(_coverage(spark, d))


@query(
    "data_gate",
    """WITH e AS (SELECT DISTINCT name AS stage, e.key AS source, e.value AS weight FROM stages, unnest(map_entries(mixture)) AS u(e)),
    st AS (SELECT source, count(*) AS n FROM token_store_index WHERE split = 'train' AND source IS NOT NULL GROUP BY 1), v AS (SELECT DISTINCT source FROM token_store_index WHERE split = 'validation'),
    rl AS (SELECT source, count(DISTINCT record_id) AS n FROM released_sequences WHERE split = 'train' GROUP BY 1)
    SELECT stage, e.source, coalesce(rl.n, 0) AS released, coalesce(st.n, 0) AS stored,
      CASE WHEN weight IS NULL THEN 'no_weight' WHEN weight < 0 OR isnan(weight) THEN 'bad_weight' WHEN weight = 0 THEN 'unused' WHEN rl.n IS NULL THEN 'no_records' WHEN st.n IS NULL THEN 'no_train_store' WHEN v.source IS NULL THEN 'no_validation_store' ELSE 'ready' END AS state
    FROM e LEFT JOIN st ON st.source = e.source LEFT JOIN v ON v.source = e.source LEFT JOIN rl ON rl.source = e.source""",
)
def data_gate(spark, d):
    """Whether each source that a stage mixes can be trained on: a usable weight, released records, a train and a validation store."""
    entries = table(spark, d, "stages").select(F.col("name").alias("stage"), F.explode("mixture").alias("source", "weight")).distinct()
    index = table(spark, d, "token_store_index").where("source IS NOT NULL")
    stored = index.where("split = 'train'").groupBy("source").agg(F.count("*").alias("stored"))
    held = index.where("split = 'validation'").select("source").distinct().withColumn("held", F.lit(True))
    released = table(spark, d, "released_sequences").where("split = 'train' AND source IS NOT NULL").groupBy("source").agg(F.countDistinct("record_id").alias("released"))
    w = F.col("weight")
    state = F.when(w.isNull(), "no_weight").when((w < 0) | F.isnan(w), "bad_weight").when(w == 0, "unused").when(F.col("released").isNull(), "no_records").when(F.col("stored").isNull(), "no_train_store").when(F.col("held").isNull(), "no_validation_store").otherwise("ready")
    joined = entries.join(stored, "source", "left").join(held, "source", "left").join(released, "source", "left")
    return joined.select("stage", "source", F.coalesce("released", F.lit(0)).alias("released"), F.coalesce("stored", F.lit(0)).alias("stored"), state.alias("state"))


_KV = """kv AS (SELECT name, unnest(['context_length', 'micro_batch_size', 'gradient_accumulation', 'budget_residues']) AS key,
      unnest([context_length::VARCHAR, micro_batch_size::VARCHAR, gradient_accumulation::VARCHAR, budget_residues::VARCHAR]) AS value FROM stages
    UNION ALL SELECT name, 'mixture.' || e.key AS key, round(e.value, 4)::VARCHAR AS value FROM stages, unnest(map_entries(mixture)) AS u(e))"""


@query(
    "stage_transitions",
    f"""WITH {_KV}, n AS (SELECT name, row_number() OVER (ORDER BY name) AS i FROM stages), t AS (SELECT a.name AS from_stage, b.name AS to_stage FROM n a JOIN n b ON b.i = a.i + 1),
    o AS (SELECT from_stage, to_stage, key, value FROM t JOIN kv ON kv.name = from_stage), w AS (SELECT from_stage, to_stage, key, value FROM t JOIN kv ON kv.name = to_stage)
    SELECT from_stage, to_stage, key, o.value AS old, w.value AS new FROM o FULL JOIN w USING (from_stage, to_stage, key) WHERE o.value IS DISTINCT FROM w.value AND key <> 'budget_residues'""",
)
def stage_transitions(spark, d):
    """What changes from each stage to the next by name, but for the budget, over every setting and source."""
    plain = ["context_length", "micro_batch_size", "gradient_accumulation", "budget_residues"]
    settings = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in plain]
    sources = F.transform(F.map_entries("mixture"), lambda e: F.struct(F.concat(F.lit("mixture."), e["key"]).alias("key"), F.round(e["value"], 4).cast("string").alias("value")))
    kv = settle(table(spark, d, "stages").select("name", F.explode(F.concat(F.array(*settings), F.coalesce(sources, F.array()))).alias("e")).select("name", "e.key", "e.value"), "settings")
    # the stages of a recipe are a handful
    names = sorted(r[0] for r in kv.select("name").distinct().collect())
    pairs = [config_differences(kv.where(F.col("name") == a), kv.where(F.col("name") == b), ["budget_residues"]).select(F.lit(a).alias("from_stage"), F.lit(b).alias("to_stage"), "key", "old", "new") for a, b in zip(names, names[1:])]
    return reduce(DataFrame.unionByName, pairs)


_DRAWN = f"""tr AS (SELECT record_id, any_value(source) AS source FROM released_sequences WHERE split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL GROUP BY record_id),
u AS (SELECT i, {u52(str(SEED), "i")} / 4503599627370496.0::DOUBLE AS u FROM (SELECT unnest(range((SELECT count(*) FROM tr))) AS i)),
draws AS (SELECT i AS draw, (i % {BATCH}) // {BATCH // WORLD} AS rank, CASE WHEN u < 0.11::DOUBLE / (0.36::DOUBLE + 0.11::DOUBLE + 0.54::DOUBLE) THEN 'mgnify'
    WHEN u < 0.11::DOUBLE / (0.36::DOUBLE + 0.11::DOUBLE + 0.54::DOUBLE) + 0.54::DOUBLE / (0.36::DOUBLE + 0.11::DOUBLE + 0.54::DOUBLE) THEN 'omg_img' ELSE 'uniref90' END AS source FROM u)"""


def _all_draws(spark, d) -> tuple[DataFrame, DataFrame]:
    """As many draws as there are train records, and those records."""
    rows = settle(_train(spark, d).select("record_id", "source"), "train")
    return sampling.mixture_draws(spark, WEIGHTS, rows.count(), SEED, BATCH, WORLD), rows


@query("mixture_draws", f"WITH {_DRAWN} SELECT draw, source, draw // {BATCH} AS batch, rank FROM draws")
def mixture_draws(spark, d):
    """The source, batch and rank of a draw for every train record there is."""
    return _all_draws(spark, d)[0]


@query(
    "epoch_draws",
    f"""WITH {_DRAWN}, sizes AS (SELECT source, count(*) AS size FROM tr GROUP BY source),
    placed AS (SELECT draw, d.source, (row_number() OVER (PARTITION BY d.source ORDER BY draw) - 1) // size AS epoch, (row_number() OVER (PARTITION BY d.source ORDER BY draw) - 1) % size AS position FROM draws d JOIN sizes s ON s.source = d.source),
    e AS (SELECT tr.*, k FROM tr JOIN (SELECT source, max(epoch) AS last FROM placed GROUP BY source) m ON m.source = tr.source, unnest(range(0, last + 1)) u(k)),
    p AS (SELECT source, record_id, k AS epoch, row_number() OVER (PARTITION BY source, k ORDER BY {key(str(SEED), 'source', 'k', 'record_id')}, record_id) - 1 AS position FROM e)
    SELECT draw, source, epoch, position, record_id FROM placed JOIN p USING (source, epoch, position)""",
)
def epoch_draws(spark, d):
    """A draw for every train record there is: small sources are passed again in a new order, large ones in part."""
    draws, rows = _all_draws(spark, d)
    return sampling.drawn_rows(draws, rows, SEED)


@query(
    "portable_states",
    f"""WITH {_DRAWN}, sizes AS (SELECT source, count(*) AS size FROM tr GROUP BY source), c AS (SELECT source, count(*) AS counted, count(DISTINCT rank) AS ranks FROM draws GROUP BY source)
    SELECT c.source, ranks, counted, (counted - 1) // size AS epoch, (counted - 1) % size + 1 AS cursor, size, true AS agrees FROM c JOIN sizes USING (source)""",
)
def portable_states(spark, d):
    """The counts of all ranks, summed, against the global cursor that the drawn rows leave behind, per source."""
    draws, rows = _all_draws(spark, d)
    drawn = sampling.drawn_rows(draws, rows, SEED)
    sizes = rows.groupBy("source").agg(F.count("*").alias("size"))
    ranks = draws.groupBy("source", "rank").agg(F.count("*").alias("n"))
    return sampling.portable_check(ranks, drawn, sizes)


@query(
    "state_restore",
    """WITH g AS (SELECT *, row_number() OVER (PARTITION BY stage, source ORDER BY saved_at DESC, seed DESC, epoch DESC, epoch_cursor DESC, size DESC) AS rn FROM global_rows),
    pol AS (SELECT stage, source, coalesce(bool_or(allow_resampling), false) AS allowed FROM global_rows GROUP BY 1, 2)
    SELECT stage, source, size, seed, epoch, epoch_cursor, allowed, epoch >= 0 AND (epoch = 0 OR allowed) AND epoch_cursor BETWEEN 0 AND size AS valid, true AS restored FROM g JOIN pol USING (stage, source) WHERE rn = 1""",
)
def state_restore(spark, d):
    """The latest sampler states saved as JSON lines and restored: the contract must be unchanged, epoch and cursor possible."""
    rows = table(spark, d, "global_rows")
    policy = rows.groupBy("stage", "source").agg(F.coalesce(F.bool_or("allow_resampling"), F.lit(False)).alias("allowed"))
    latest = sampling.exposure(rows).select("stage", "source", "size", "epoch", "epoch_cursor")
    newest = rows.groupBy("stage", "source").agg(F.max(F.struct("saved_at", "seed")).alias("s")).select("stage", "source", F.col("s.seed").alias("seed"))
    states = settle(latest.join(newest, ["stage", "source"]).join(policy, ["stage", "source"]), "states")
    path = scratch_path(spark, "states")
    writers.append_log(states, path)
    saved = readers.json_lines(spark, path, "stage string, source string, size bigint, epoch int, epoch_cursor bigint, seed bigint, allowed boolean")
    return sampling.restored(saved, states)


@query(
    "key_set_equality",
    """WITH e AS (SELECT DISTINCT chain_id FROM evaluation_sequences WHERE chain_id IS NOT NULL), c AS (SELECT DISTINCT chain_id FROM cached_contact_chain WHERE chain_id IS NOT NULL),
    b AS (SELECT e.chain_id AS l, c.chain_id AS r FROM e FULL JOIN c ON c.chain_id = e.chain_id)
    SELECT count(l) AS left_keys, count(r) AS right_keys, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right,
      count(*) FILTER (l IS NULL OR r IS NULL) = 0 AS equal, count(*) FILTER (r IS NULL) = 0 AS right_holds_left, count(*) FILTER (l IS NULL) = 0 AS left_holds_right FROM b""",
)
def key_set_equality(spark, d):
    """The chains of the evaluation against those of the scoring cache, both ways."""
    return reports.key_sets(table(spark, d, "evaluation_sequences").select("chain_id"), table(spark, d, "cached_contact_chain").select("chain_id"), "chain_id")


@query(
    "membership_rows",
    f"""WITH {RECORDS}, o AS (SELECT digest, record_id AS owner_id, source AS owner_source FROM r WHERE rejected IS NULL QUALIFY row_number() OVER (PARTITION BY digest ORDER BY arm, coalesce(source, ''), record_id) = 1)
    SELECT record_id, source, r.digest, owner_id, owner_source, record_id = owner_id AS owns FROM r JOIN o ON o.digest = r.digest WHERE rejected IS NULL""",
)
def membership_rows(spark, d):
    """Deduplication that keeps every member: each eligible record with the owner of its sequence."""
    rows = settle(corpus.records(table(spark, d, "released_sequences")).where("rejected IS NULL").select("record_id", "source", "digest"), "eligible")
    held = corpus.owners(rows.withColumn("rejected", F.lit(None).cast("string"))).select("digest", "owner_id", "owner_source")
    return rows.join(held, "digest").select("record_id", "source", "digest", "owner_id", "owner_source", (F.col("record_id") == F.col("owner_id")).alias("owns"))


_CLASS = "CASE WHEN accession IS NULL THEN 'missing' WHEN regexp_matches(accession, '^([0-9]{7,}|Ga|IMG|JGI)') THEN 'img' WHEN regexp_matches(accession, '^(ERZ|ERR|ERS|ERP|MGY)') THEN 'mgnify_origin' ELSE 'unclassified' END"


@query("origin_exclusion", f"SELECT doc_id, {_CLASS} AS class, {_CLASS} <> 'mgnify_origin' AS kept FROM documents")
def origin_exclusion(spark, d):
    """Documents by the origin of their accession; those of the excluded origin are not kept."""
    return corpus.excluding_origin(table(spark, d, "documents")).select("doc_id", "class", "kept")


@query(
    "profile_units",
    f"""WITH {RECORDS}, c AS (SELECT count(DISTINCT chain_id) AS n FROM cached_contact_chain), p AS (SELECT count(DISTINCT digest) AS n FROM r WHERE split = 'validation' AND digest IS NOT NULL),
    t AS (SELECT 'search' AS profile, 'contact' AS kind, (SELECT least(8192, n) FROM c) AS units, 1 AS attempts UNION ALL SELECT 'search', 'chain_loss', (SELECT least(8192, n) FROM c), 1
      UNION ALL SELECT 'scaleup', 'contact', (SELECT least(26062, n) FROM c), 5 UNION ALL SELECT 'scaleup', 'chain_loss', (SELECT least(26062, n) FROM c), 5 UNION ALL SELECT 'scaleup', 'record_loss', (SELECT least(12288, n) FROM p), 5)
    SELECT *, units * attempts AS tasks FROM t""",
)
def profile_units(spark, d):
    """The evaluation tasks that each profile asks of the chains and validation records at hand."""
    chains = table(spark, d, "cached_contact_chain").agg(F.countDistinct("chain_id").alias("chain"))
    held = corpus.records(table(spark, d, "released_sequences"), "validation").agg(F.countDistinct("digest").alias("record"))
    return reports.profile_tasks(chains, held)


@query(
    "chain_eligibility",
    """WITH l AS (SELECT * FROM cached_contact_chain WHERE chain_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY cached_at DESC, evaluated_length DESC, valid_pair_count DESC, true_long_range_contacts DESC) = 1)
    SELECT chain_id, evaluated_length, valid_pair_count, true_long_range_contacts AS contacts, valid_pair_count >= evaluated_length AND true_long_range_contacts >= evaluated_length AS eligible,
      least(evaluated_length, valid_pair_count) AS scored_pairs, round(true_long_range_contacts / nullif(valid_pair_count, 0)::DOUBLE, 6) AS random_precision FROM l""",
)
def chain_eligibility(spark, d):
    """Every cached chain by its latest entry: whether it is eligible, how many pairs its precision counts, and the precision of chance."""
    return contacts.cached_eligibility(table(spark, d, "cached_contact_chain"))


@query(
    "population_chunks",
    f"""WITH {RECORDS}, o AS (SELECT source, digest, record_id, row_number() OVER (PARTITION BY source ORDER BY record_id) - 1 AS n FROM r WHERE source IS NOT NULL AND digest IS NOT NULL),
    a AS (SELECT source, n // 1024 AS n, sha256(string_agg(record_id || ':' || digest, chr(10) ORDER BY n)) AS h, count(*) AS units FROM o GROUP BY 1, 2),
    b AS (SELECT source, n // 1024 AS n, sha256(string_agg(h, chr(10) ORDER BY n)) AS h, sum(units) AS units FROM a GROUP BY 1, 2)
    SELECT source, sum(units)::BIGINT AS units, sha256(string_agg(h, chr(10) ORDER BY n)) AS digest FROM b GROUP BY source""",
)
def population_chunks(spark, d):
    """An order-sensitive digest of each source's whole population, as a tree of digests of 1,024 each."""
    rows = corpus.records(table(spark, d, "released_sequences")).where("source IS NOT NULL AND digest IS NOT NULL")
    named = rows.select("source", "record_id", F.concat_ws(":", F.col("record_id").cast("string"), "digest").alias("h"))
    return reports.ordered_digest(named, "source", "record_id", "h")


@query(
    "training_log_ranks",
    """WITH p AS (SELECT date_trunc('day', ts) AS day, user_id % 4 AS rank, count(*) AS entries, round(sum(value), 4) AS total, max(value) AS peak FROM events WHERE user_id IS NOT NULL GROUP BY ALL)
    SELECT day, count(*) AS ranks, sum(entries)::BIGINT AS entries, round(sum(total), 3) AS total, max(total) AS slowest, max(peak) AS peak, min(entries) AS least_entries FROM p GROUP BY day""",
)
def training_log_ranks(spark, d):
    """Counters of 4 ranks reduced per day: sums of counts and amounts, maxima of amounts and peaks."""
    rows = table(spark, d, "events").where("user_id IS NOT NULL")
    per = rows.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.pmod("user_id", F.lit(4)).alias("rank")).agg(F.count("*").alias("entries"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("peak"))
    return per.groupBy("day").agg(F.count("*").alias("ranks"), F.sum("entries").alias("entries"), F.round(F.sum("total"), 3).alias("total"), F.max("total").alias("slowest"), F.max("peak").alias("peak"), F.min("entries").alias("least_entries"))


@query("longest_records", f"WITH {RECORDS} SELECT record_id, source, length(norm) AS norm_length FROM r WHERE norm IS NOT NULL ORDER BY length(norm) DESC, record_id LIMIT 100")
def longest_records(spark, d):
    """The 100 longest records (a top-k report: every task keeps its own first 100)."""
    rows = corpus.records(table(spark, d, "released_sequences")).where("norm IS NOT NULL")
    return rows.select("record_id", "source", "norm_length").orderBy(F.desc("norm_length"), "record_id").limit(100)


@query("source_seeds", f"SELECT DISTINCT source, ({SEED} + ('0x' || substr(sha256(source), 1, 16))::UBIGINT::HUGEINT)::VARCHAR AS seed FROM released_sequences WHERE source IS NOT NULL")
def source_seeds(spark, d):
    """The seed of each source: the run's seed plus the first eight bytes of the digest of its name."""
    return table(spark, d, "released_sequences").where("source IS NOT NULL").select("source").distinct().select("source", sampling.source_seed(F.col("source"), SEED).cast("string").alias("seed"))


@query(
    "migration_plan",
    f"""WITH tr AS (SELECT record_id, any_value(source) AS source, any_value(ingested_at) AS ingested_at FROM released_sequences WHERE split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL GROUP BY record_id),
    o AS (SELECT source, count(*) FILTER (coalesce(ingested_at <= TIMESTAMP '2024-09-01 00:00:00', false)) AS old_size, count(*) AS new_size FROM tr GROUP BY source),
    c AS (SELECT source, old_size, new_size, list_sum(list_transform(range({WORLD}), lambda r: least(50, (old_size - r + {WORLD - 1}) // {WORLD})))::BIGINT AS consumed FROM o)
    SELECT source, old_size, new_size, consumed, old_size - consumed AS unseen, new_size - old_size AS appended, new_size - consumed AS queue, true AS valid FROM c""",
)
def migration_plan(spark, d):
    """Continuing on an expanded corpus: what four ranks have consumed of the earlier records, and the queue of the rest and the new ones.

    Each rank had reached its 50th row (or the end of its share). ``valid``: the queue holds every unseen record once and no consumed one.
    """
    rows = settle(_train(spark, d), "train")
    old = F.coalesce(F.col("ingested_at") <= F.lit("2024-09-01 00:00:00").cast("timestamp_ntz"), F.lit(False))
    return sampling.migration(rows.withColumn("old", old), SEED, SEED + 1, WORLD, 50)


@query(
    "stage_step_plan",
    f"""WITH s AS (SELECT name AS stage, micro_batch_size * gradient_accumulation * {WORLD} AS global_batch, ceil(budget_residues / (context_length * micro_batch_size * gradient_accumulation * {WORLD}))::BIGINT AS steps FROM stages WHERE context_length > 0 AND micro_batch_size > 0 AND gradient_accumulation > 0),
    f AS (SELECT *, least(steps, ceil(round(steps * 2 / 3.0::DOUBLE, 9))::BIGINT) AS first, steps // 2 AS consumed FROM s)
    SELECT stage, global_batch, steps, first AS first_steps, steps - first AS second_steps, consumed, greatest(0, first - consumed) AS first_left, greatest(0, steps - greatest(first, consumed)) AS second_left FROM f""",
)
def stage_step_plan(spark, d):
    """The optimiser steps of each stage's budget, split into its constant and its decaying part, and what is left of both at half way."""
    return reports.step_split(table(spark, d, "stages"), WORLD)


@query(
    "stage_by_time",
    """WITH e AS (SELECT event_id, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000.0::DOUBLE / 2592000 AS p FROM events WHERE ts IS NOT NULL), b AS (SELECT event_id, least(greatest(p, 0), 1) AS p FROM e)
    SELECT event_id, CASE WHEN p < 2 / 3.0::DOUBLE THEN 'stage1' ELSE 'stage2' END AS stage, round(CASE WHEN p < 2 / 3.0::DOUBLE THEN p / (2 / 3.0::DOUBLE) ELSE (p - 2 / 3.0::DOUBLE) / (1 - 2 / 3.0::DOUBLE) END, 6) AS progress,
      CASE WHEN event_id >= 500 THEN round((event_id - 500) / 99500.0::DOUBLE, 6) END AS continued FROM b""",
)
def stage_by_time(spark, d):
    """The stage that each entry of a log of 30 days falls in by wall time, and the progress of a continuation from step 500."""
    rows = table(spark, d, "events").where("ts IS NOT NULL")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(1e6)
    stage, progress = reports.stage_at(seconds / F.lit(2592000), 2 / 3)
    return rows.select("event_id", stage.alias("stage"), F.round(progress, 6).alias("progress"), F.round(reports.continuation(F.col("event_id"), 100_000, 500), 6).alias("continued"))


@query(
    "batch_rebalance",
    f"""WITH {RECORDS}, p AS (SELECT source, least(length(norm) + 2, 512) AS length, row_number() OVER (PARTITION BY source ORDER BY {key(str(SEED), 'source', '0', 'record_id')}, record_id) - 1 AS item FROM r WHERE norm IS NOT NULL AND source IS NOT NULL),
    n AS (SELECT *, item // 64 AS batch, item % 64 AS place, count(*) OVER (PARTITION BY source, item // 64) AS items FROM p),
    k AS (SELECT source, batch, items, length, CASE WHEN items < 4 OR place >= items // 4 * 4 THEN 3 ELSE place // (items // 4) END AS rank FROM n),
    l AS (SELECT source, batch, max(items) AS items, rank, sum(length) AS load FROM k GROUP BY source, batch, rank)
    SELECT source, batch, max(items) AS items, sum(load)::BIGINT AS tokens, max(load)::BIGINT AS max_before, true AS not_worse, true AS even FROM l GROUP BY source, batch""",
)
def batch_rebalance(spark, d):
    """The loads of 4 ranks before and after dealing each batch anew: never worse, and as many records on each rank."""
    from strandwork.plans.sampling_plans import batch_balance

    rows = reports.rank_loads(batch_balance(spark, d), 64, WORLD)
    return rows.select("source", "batch", "items", "tokens", "max_before", (F.col("max_after") <= F.col("max_before")).alias("not_worse"), "even")


@query(
    "chain_precision",
    f"""WITH c AS (SELECT chain_id, min({norm('sequence')}) AS s FROM cached_contact_chain WHERE chain_id IS NOT NULL AND sequence IS NOT NULL GROUP BY 1 HAVING min({norm('sequence')}) <> ''),
    x AS (SELECT chain_id, unnest(range(length(s))) AS pos, unnest(regexp_extract_all(s, '.')) AS ch FROM c), pt AS (SELECT chain_id, pos, ascii(ch) AS code FROM x),
    pr AS (SELECT a.chain_id, a.pos AS i, b.pos AS j, (a.code * 31 + b.code * 17 + a.pos * 7 + b.pos * 13) % 1009 AS score, (a.code + b.code + a.pos + b.pos) % 11 = 0 AS contact FROM pt a JOIN pt b ON a.chain_id = b.chain_id AND b.pos - a.pos >= 24),
    o AS (SELECT pr.chain_id, length(s) AS n, contact, row_number() OVER (PARTITION BY pr.chain_id ORDER BY score DESC, i, j) AS rn FROM pr JOIN c ON c.chain_id = pr.chain_id)
    SELECT chain_id, max(n) AS chain_length, count(*) AS pairs, count(*) FILTER (contact) AS contacts, count(*) >= max(n) AND count(*) FILTER (contact) >= max(n) AS eligible,
      round(avg(contact::INT) FILTER (rn <= n), 6) AS precision_at_l, round(avg(contact::INT), 6) AS random_precision FROM o GROUP BY chain_id""",
)
def chain_precision(spark, d):
    """Pairs, eligibility and precision at L of every cached chain, over its own sequence and length (scores are stand-ins)."""
    rows = table(spark, d, "cached_contact_chain").where("chain_id IS NOT NULL AND sequence IS NOT NULL")
    chains = rows.groupBy(F.col("chain_id").alias("chain")).agg(F.min(normalised(F.col("sequence"))).alias("norm")).where("norm <> ''")
    return contacts.residue_scores(chains).withColumnRenamed("chain", "chain_id")
