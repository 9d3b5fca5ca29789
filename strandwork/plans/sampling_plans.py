"""Queries over permutations, draws, exposure, masks and losses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.functions.sequence import CANONICAL, normalised
from strandwork.operators import corpus, masking, reports, sampling
from strandwork.plans.registry import query
from strandwork.plans.sql import RECORDS, key, norm, u52
from strandwork.runtime import settle, table

SEED = 20260820
WORLD = 4
#: Weights of the mixture draws; there are as many draws as train records.
WEIGHTS = {"uniref90": 0.36, "mgnify": 0.11, "omg_img": 0.54}
BATCH = 256
CUT = "2024-09-01 00:00:00"
CURSOR = 5


def _train(spark, d) -> DataFrame:
    """``record_id, source, ingested_at`` of the train records, each once; identical rows repeat."""
    rows = table(spark, d, "released_sequences").where("split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL")
    return rows.select("record_id", "source", "ingested_at").dropDuplicates(["record_id"])


_TR = "tr AS (SELECT record_id, any_value(source) AS source, any_value(ingested_at) AS ingested_at FROM released_sequences WHERE split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL GROUP BY record_id)"


def perm_sql(rows: str, seed: int, epoch: str = "0") -> str:
    return f"SELECT source, record_id, {epoch} AS epoch, row_number() OVER (PARTITION BY source, {epoch} ORDER BY {key(str(seed), 'source', epoch, 'record_id')}, record_id) - 1 AS position FROM {rows}"


@query("epoch_permutation", f"WITH {_TR} {perm_sql('tr', SEED)}")
def epoch_permutation(spark, d):
    return sampling.permutation(_train(spark, d), SEED)


@query(
    "rank_partition",
    f"WITH {_TR}, p AS ({perm_sql('tr', SEED)}) SELECT source, position % {WORLD} AS rank, count(*) AS rows, min(position) AS first_position, sum(record_id)::BIGINT AS id_sum FROM p GROUP BY ALL",
)
def rank_partition(spark, d):
    return sampling.rank_shares(sampling.permutation(_train(spark, d), SEED), WORLD)


@query(
    "source_exposure",
    """WITH g AS (SELECT *, coalesce((json_extract_string(origin, '$.prior'))::BIGINT, 0) AS prior, row_number() OVER (PARTITION BY stage, source ORDER BY saved_at DESC, seed DESC, epoch DESC, epoch_cursor DESC, size DESC) AS rn FROM global_rows),
    x AS (SELECT *, prior + epoch * size + epoch_cursor AS draws FROM g WHERE rn = 1)
    SELECT stage, source, size, epoch, epoch_cursor, prior, draws, least(draws, size) AS unique_records, greatest(draws - size, 0) AS repeated_draws, draws // 4 AS draws_per_rank, draws % 4 AS extra_ranks FROM x""",
)
def source_exposure(spark, d):
    return sampling.exposure(table(spark, d, "global_rows"))


@query(
    "state_consistency",
    """SELECT stage, source, count(*) AS states, count(DISTINCT size) AS sizes, count(DISTINCT seed) AS seeds, count(DISTINCT allow_resampling) <= 1 AS policies_agree,
    count(*) FILTER (allow_resampling IS NULL) AS policy_unknown, count(*) FILTER (epoch_cursor > size) AS cursor_beyond_size FROM global_rows GROUP BY ALL""",
)
def state_consistency(spark, d):
    return sampling.state_consistency(table(spark, d, "global_rows"))


@query("unseen_complement", f"WITH {_TR}, p AS ({perm_sql('tr', SEED)}) SELECT source, record_id, epoch, position FROM p WHERE position // {WORLD} >= {CURSOR}")
def unseen_complement(spark, d):
    return sampling.unseen(sampling.permutation(_train(spark, d), SEED), WORLD, CURSOR)


@query(
    "expansion_queue",
    f"""WITH {_TR}, old AS (SELECT * FROM tr WHERE coalesce(ingested_at <= TIMESTAMP '{CUT}', false)), p AS ({perm_sql('old', SEED)}),
    q AS (SELECT source, record_id FROM p WHERE position // {WORLD} >= {CURSOR} UNION ALL SELECT source, record_id FROM tr WHERE NOT coalesce(ingested_at <= TIMESTAMP '{CUT}', false)),
    n AS ({perm_sql('q', SEED + 1)}) SELECT source, record_id, position FROM n""",
)
def expansion_queue(spark, d):
    return sampling.expansion_queue(_train(spark, d), CUT, SEED, SEED + 1, WORLD, CURSOR)


@query(
    "budget_fragments",
    f"""WITH f AS (SELECT path, count(DISTINCT record_id) AS records FROM released_sequences GROUP BY path),
    o AS (SELECT path, records, row_number() OVER w AS rn, (sum(records) OVER w - records)::BIGINT AS before FROM f WINDOW w AS (ORDER BY {key(str(SEED), "path")}, path))
    SELECT path, records, rn, before, (rn - 1) // 10 AS chunk FROM o WHERE before < 5000""",
)
def budget_fragments(spark, d):
    fragments = table(spark, d, "released_sequences").groupBy("path").agg(F.countDistinct("record_id").alias("records"))
    return sampling.fragments_for_budget(fragments, SEED, 5000, 10)


@query(
    "crop_offsets",
    f"WITH {RECORDS} SELECT record_id, CASE WHEN length(norm) > 126 THEN {u52('20260821', 'digest')} % (length(norm) - 126 + 1) ELSE 0 END AS crop_start FROM r WHERE norm IS NOT NULL",
)
def crop_offsets(spark, d):
    rows = corpus.records(table(spark, d, "released_sequences")).where("norm_length IS NOT NULL")
    return rows.select("record_id", sampling.crop_offset(F.col("digest"), F.col("norm_length"), 126, 20260821).alias("crop_start"))


def mask_sql(rows: str, seed: str, extra: str) -> str:
    """Crops and masked positions; ``rows`` has ``norm, digest`` and the columns ``extra``."""
    start = f"CASE WHEN length(norm) > {masking.LIMIT} THEN {u52('20260821', 'digest')} % (length(norm) - {masking.LIMIT} + 1) ELSE 0 END"
    return f"""
    c AS (SELECT {extra}, digest, substring(norm, ({start} + 1)::BIGINT, {masking.LIMIT}) AS crop FROM {rows} WHERE norm IS NOT NULL),
    e AS (SELECT {extra}, digest, crop, list_filter(range(1, length(crop) + 1), lambda p: contains('{CANONICAL}', substring(crop, p, 1))) AS eligible FROM c),
    h AS (SELECT *, list_transform(eligible, lambda p: {{'u': {u52(seed, 'digest', 'p')}, 'p': p}}) AS ranked FROM e),
    m AS (SELECT *, CASE WHEN len(list_filter(ranked, lambda x: x.u < {int(masking.RATE * (1 << 52))})) > 0 THEN list_transform(list_filter(ranked, lambda x: x.u < {int(masking.RATE * (1 << 52))}), lambda x: x.p)
       WHEN len(ranked) > 0 THEN [list_min(ranked).p] ELSE [] END AS targets FROM h)"""


@query(
    "mlm_mask",
    f"""WITH {RECORDS}, v AS (SELECT * FROM r WHERE split = 'validation'), {mask_sql('v', str(20260821), 'record_id')}
    SELECT record_id, len(eligible) AS eligible, len(targets) AS targets, coalesce(list_sum(targets), 0)::BIGINT AS position_sum FROM m""",
)
def mlm_mask(spark, d):
    rows = masking.masked(corpus.records(table(spark, d, "released_sequences"), "validation"), 20260821)
    total = F.aggregate("targets", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return rows.select("record_id", F.size("eligible").alias("eligible"), F.size("targets").alias("targets"), total.alias("position_sum"))


MASK_SEEDS = [20260821, 20260822, 20260823, 20260824, 20260825]


def _evaluation_units(spark, d) -> DataFrame:
    rows = table(spark, d, "evaluation_sequences").where("sequence IS NOT NULL").select("evaluation_id", normalised(F.col("sequence")).alias("norm")).distinct()
    return rows.select("evaluation_id", "norm", F.sha2("norm", 256).alias("digest"))


_EV = f"ev AS (SELECT DISTINCT evaluation_id, {norm('sequence')} AS norm FROM evaluation_sequences WHERE sequence IS NOT NULL), ev2 AS (SELECT *, sha256(norm) AS digest FROM ev), seeds AS (SELECT unnest({MASK_SEEDS}) AS seed), ev3 AS (SELECT * FROM ev2, seeds)"


@query(
    "mask_seed_sweep",
    f"""WITH {_EV}, {mask_sql('ev3', 'seed', 'evaluation_id, seed')}, s AS (SELECT seed, avg(len(targets) / greatest(len(eligible), 1)) AS share, count(*) AS n FROM m GROUP BY seed)
    SELECT round(avg(share), 6) AS mean_share, round(stddev_samp(share), 6) AS sd_share, count(*) AS seeds, max(n) AS units FROM s""",
)
def mask_seed_sweep(spark, d):
    """Masked share over five mask seeds: mean and SD over the seeds."""
    units = _evaluation_units(spark, d)
    per = None
    for seed in MASK_SEEDS:
        m = masking.masked(units, seed).agg(F.avg(F.size("targets") / F.greatest(F.size("eligible"), F.lit(1))).alias("share"), F.count("*").alias("n"))
        per = m if per is None else per.unionByName(m)
    return per.agg(F.round(F.avg("share"), 6).alias("mean_share"), F.round(F.stddev_samp("share"), 6).alias("sd_share"), F.count("*").alias("seeds"), F.max("n").alias("units"))


_LOSS = f"""{RECORDS}, tok AS (SELECT c, count(*) AS n FROM (SELECT unnest(regexp_extract_all(norm, '.')) AS c FROM r WHERE split = 'train' AND norm IS NOT NULL) GROUP BY c),
v AS (SELECT * FROM r WHERE split = 'validation'), {mask_sql('v', str(20260821), 'record_id, source')},
p AS (SELECT record_id, unnest(targets) AS p, crop FROM m), losses AS (SELECT c, -ln((n + 1) / (SELECT sum(n) + 25 FROM tok)::DOUBLE) AS l FROM tok),
unit AS (SELECT p.record_id, avg(l) AS loss FROM p JOIN losses ON c = substring(crop, p, 1) GROUP BY 1),
units AS (SELECT m.source, len(targets) AS k, coalesce(loss, 0) AS loss FROM m LEFT JOIN unit ON unit.record_id = m.record_id)
SELECT source, count(*) AS units, count(*) FILTER (k = 0) AS zero_target_units, sum(k)::BIGINT AS targets, round(avg(loss), 6) AS macro_loss,
       round(sum(k * loss) / greatest(sum(k), 1), 6) AS target_loss, round(sum(sqrt(k) * loss) / greatest(sum(sqrt(k)), 1), 6) AS root_loss FROM units GROUP BY source"""


@query("unigram_losses", f"WITH {_LOSS}")
def unigram_losses(spark, d):
    """Masked losses of a unigram model of the train split, by source: macro, target- and root-weighted."""
    released = table(spark, d, "released_sequences")
    losses = masking.unigram_losses(corpus.records(released, "train").where("norm IS NOT NULL"))
    units = masking.unit_losses(masking.masked(corpus.records(released, "validation"), 20260821), losses)
    return masking.loss_report(units, ["source"])


@query(
    "length_batches",
    f"""WITH {RECORDS}, o AS (SELECT record_id, length(norm) AS length, row_number() OVER (ORDER BY length(norm), record_id) AS rn FROM r WHERE norm IS NOT NULL)
    SELECT record_id, length, (rn - 1) // 32 AS batch, ((rn - 1) // 32) % 4 AS worker FROM o""",
)
def length_batches(spark, d):
    rows = corpus.records(table(spark, d, "released_sequences")).select("record_id", F.col("norm_length").alias("length"))
    return reports.length_batches(rows, "record_id", 32, 4)


@query("batch_balance")
def batch_balance(spark, d):
    """Batches of 64 consecutive permuted records, dealt to 4 ranks by balanced load (sequential inside a batch)."""
    rows = settle(corpus.records(table(spark, d, "released_sequences")).where("norm_length IS NOT NULL AND source IS NOT NULL").select("record_id", "source", F.col("norm_length").alias("length")), "balance-records")
    order = settle(sampling.permutation(rows, SEED), "balance-order").join(rows.select("record_id", "length"), "record_id")
    batches = order.select("source", F.floor(F.col("position") / 64).alias("batch"), F.col("position").alias("item"), F.least(F.col("length") + 2, F.lit(512)).cast("bigint").alias("length"))
    return reports.balance_batches(batches, WORLD)


@query(
    "hash_ranked_subset",
    f"""WITH c AS (SELECT DISTINCT chain_id FROM cached_contact_chain WHERE chain_id IS NOT NULL), o AS (SELECT chain_id, row_number() OVER (ORDER BY {key(str(SEED), "chain_id")}, chain_id) AS rn FROM c)
    SELECT chain_id, rn, (rn - 1) % 4 AS shard FROM o WHERE rn <= 8192""",
)
def hash_ranked_subset(spark, d):
    """The evaluation subset: the first 8,192 chains by seeded hash, dealt to 4 workers."""
    return sampling.hashed_subset(table(spark, d, "cached_contact_chain"), "chain_id", SEED, 8192, 4)


@query(
    "ordered_population",
    f"""WITH c AS (SELECT chain_id, min(cached_at) AS t FROM cached_contact_chain WHERE chain_id IS NOT NULL GROUP BY 1), a AS (SELECT chain_id, row_number() OVER (ORDER BY t, chain_id) AS n FROM c), b AS (SELECT chain_id, row_number() OVER (ORDER BY chain_id) AS n FROM c)
    SELECT count(*) AS rows, count(*) FILTER (a.chain_id IS DISTINCT FROM b.chain_id) AS different, count(*) FILTER (a.n IS NULL) AS only_right, count(*) FILTER (b.n IS NULL) AS only_left FROM a FULL JOIN b ON a.n = b.n""",
)
def ordered_population(spark, d):
    """The chains in the order they were cached against their order by id."""
    from strandwork.operators.ordering import ranked

    chains = table(spark, d, "cached_contact_chain").where("chain_id IS NOT NULL").groupBy("chain_id").agg(F.min("cached_at").alias("t"))
    return reports.ordered_equal(ranked(chains, [], ["t", "chain_id"]), ranked(chains, [], ["chain_id"]), "rn", "chain_id")
