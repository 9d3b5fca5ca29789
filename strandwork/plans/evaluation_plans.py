"""Queries over contacts, probes, reports, schedules and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.sequence import normalised
from strandwork.operators import contacts, reports
from strandwork.operators.ordering import ranked
from strandwork.plans.registry import query
from strandwork.plans.sql import key, norm, u52
from strandwork.runtime import settle, table
from strandwork.streaming import ingest


def _points(spark, d) -> DataFrame:
    return contacts.positions(table(spark, d, "embeddings"))


def _pairs(spark, d) -> DataFrame:
    return contacts.scored_pairs(_points(spark, d))


_POINTS = "pt AS (SELECT vec_id // 100 AS chain, vec_id % 100 AS pos, label, embedding FROM embeddings WHERE embedding IS NOT NULL)"
_PAIRS = f"""{_POINTS}, pr AS (SELECT a.chain, a.pos AS i, b.pos AS j, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 9) AS score, coalesce(a.label = b.label, false) AS contact
  FROM pt a JOIN pt b ON a.chain = b.chain AND b.pos - a.pos >= 24)"""


@query("contact_pairs", f"WITH {_PAIRS} SELECT chain, i, j, score, contact FROM pr")
def contact_pairs(spark, d):
    return _pairs(spark, d)


_ELIGIBLE = f"""WITH {_PAIRS}, z AS (SELECT chain, count(*) AS chain_length FROM pt GROUP BY chain), p AS (SELECT chain, count(*) AS pairs, count(*) FILTER (contact) AS contacts FROM pr GROUP BY chain)"""


@query("contact_eligibility", f"{_ELIGIBLE} SELECT z.chain, chain_length, coalesce(pairs, 0) AS pairs, coalesce(contacts, 0) AS contacts, coalesce(pairs, 0) >= chain_length AND coalesce(contacts, 0) >= chain_length AS eligible FROM z LEFT JOIN p ON p.chain = z.chain")
def contact_eligibility(spark, d):
    return contacts.eligibility(_points(spark, d), _pairs(spark, d))


_PRECISION = f"""{_ELIGIBLE}, o AS (SELECT pr.*, row_number() OVER (PARTITION BY pr.chain ORDER BY score DESC, i, j) AS rn FROM pr),
t AS (SELECT o.chain, round(avg(contact::INT), 6) AS precision_at_l FROM o JOIN z ON z.chain = o.chain WHERE rn <= chain_length GROUP BY 1),
b AS (SELECT chain, round(avg(contact::INT), 6) AS random_precision FROM pr GROUP BY 1), q AS (SELECT t.chain, precision_at_l, random_precision FROM t JOIN b ON b.chain = t.chain)"""


@query("precision_at_l", f"{_PRECISION} SELECT * FROM q")
def precision_at_l(spark, d):
    return contacts.precision_at_length(_points(spark, d), _pairs(spark, d))


@query("precision_macro", f"{_PRECISION} SELECT count(*) AS chains, round(avg(precision_at_l), 6) AS precision_at_l, round(avg(random_precision), 6) AS random_precision FROM q")
def precision_macro(spark, d):
    rows = contacts.precision_at_length(_points(spark, d), _pairs(spark, d))
    return rows.agg(F.count("*").alias("chains"), F.round(F.avg("precision_at_l"), 6).alias("precision_at_l"), F.round(F.avg("random_precision"), 6).alias("random_precision"))


PAIRS_PER_CLASS = 4096


@query("pair_sample_balanced_4096", f"WITH {_PAIRS} SELECT chain, contact, i, j, row_number() OVER (PARTITION BY chain, contact ORDER BY {key('20260819', 'chain', 'i', 'j')}) AS rn FROM pr QUALIFY rn <= {PAIRS_PER_CLASS}")
def pair_sample_balanced_4096(spark, d):
    """Up to the published number of pairs of each class and chain, which no chain of 100 positions reaches."""
    return contacts.balanced_pairs(_pairs(spark, d), PAIRS_PER_CLASS, 20260819)


@query(
    "symmetrize",
    f"""WITH {_POINTS} SELECT a.chain, a.pos AS i, b.pos AS j, round((a.embedding[b.pos + 1]::DOUBLE + b.embedding[a.pos + 1]::DOUBLE) / 2, 6) AS value
    FROM pt a JOIN pt b ON a.chain = b.chain AND a.pos <= b.pos WHERE b.pos < 64""",
)
def symmetrize(spark, d):
    return contacts.symmetrised(_points(spark, d))


COEFFICIENTS = {k: (k - 31) / 64 for k in range(0, 64, 7)}


@query("linear_probe_score", "SELECT vec_id, round(" + " + ".join(["0.25::DOUBLE"] + [f"embedding[{k + 1}]::DOUBLE * ({v})::DOUBLE" for k, v in COEFFICIENTS.items() if v]) + ", 6) AS score FROM embeddings")
def linear_probe_score(spark, d):
    return contacts.probe_scores(table(spark, d, "embeddings"), COEFFICIENTS, 0.25)


@query(
    "average_precision",
    """WITH s AS (SELECT label AS grp, round(embedding[2], 2)::DOUBLE AS score, embedding[1] > 0 AS target FROM embeddings WHERE label IS NOT NULL),
    p AS (SELECT grp, score, count(*) FILTER (target) AS tp, count(*) AS n FROM s GROUP BY ALL),
    c AS (SELECT grp, tp, n, tp / nullif(sum(tp) OVER (PARTITION BY grp), 0) * sum(tp) OVER (PARTITION BY grp ORDER BY score DESC) / sum(n) OVER (PARTITION BY grp ORDER BY score DESC) AS step FROM p)
    SELECT grp, round(sum(step), 6) AS average_precision, sum(tp)::BIGINT AS positives, sum(n)::BIGINT AS rows FROM c GROUP BY grp""",
)
def average_precision(spark, d):
    rows = table(spark, d, "embeddings").where("label IS NOT NULL")
    return contacts.average_precision(rows.select(F.col("label").alias("grp"), F.round(F.element_at("embedding", 2), 2).cast("double").alias("score"), (F.element_at("embedding", 1) > 0).alias("target")))


@query("probe_fit")
def probe_fit(spark, d):
    return contacts.fit_probe(table(spark, d, "embeddings"))


@query(
    "bootstrap_ci",
    f"""{_PRECISION}, v AS (SELECT chain AS idx, precision_at_l AS value FROM q), n AS (SELECT count(*) AS n FROM v),
    dr AS (SELECT i // n AS replicate, {u52('20260821', 'i')} % n AS idx FROM n, unnest(range(0, 500 * n)) u(i)),
    m AS (SELECT replicate, avg(value) AS m FROM dr JOIN v ON v.idx = dr.idx GROUP BY 1)
    SELECT (SELECT round(avg(value), 6) FROM v) AS mean, (SELECT n FROM n) AS n, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""",
)
def bootstrap_ci(spark, d):
    rows = settle(contacts.precision_at_length(_points(spark, d), _pairs(spark, d)).select(F.col("chain").alias("idx"), F.col("precision_at_l").alias("value")), "precision")
    return contacts.bootstrap_interval(rows, 500, 20260821)


@query(
    "cache_checks",
    """SELECT cache_id, count(*) AS entries, count(DISTINCT chain_id) AS chains,
    count(*) FILTER (pair_count <> CASE WHEN evaluated_length > 24 THEN (evaluated_length - 24) * (evaluated_length - 23) // 2 ELSE 0 END) AS wrong_pairs,
    count(*) FILTER (valid_bytes <> ceil(pair_count / 8) OR contact_bytes <> ceil(pair_count / 8)) AS wrong_bytes, count(*) FILTER (contact_offset <> valid_offset + valid_bytes) AS gaps,
    count(*) FILTER (valid_pair_count >= evaluated_length AND true_long_range_contacts >= evaluated_length) AS eligible, count(*) FILTER (valid_pair_count > pair_count) AS too_many_valid, count(*) FILTER (source_payload_sha256 IS NULL) AS no_payload
    FROM cached_contact_chain GROUP BY cache_id""",
)
def cache_checks(spark, d):
    return contacts.cache_checks(table(spark, d, "cached_contact_chain"))


@query("mean_sd_report", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def mean_sd_report(spark, d):
    return reports.mean_sd(table(spark, d, "events"), "event_type", "value")


@query(
    "training_log_rollup",
    "SELECT date_trunc('day', ts) AS day, coalesce(event_type, '(none)') AS kind, count(*) AS entries, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total, max(value) AS peak FROM events GROUP BY ALL",
)
def training_log_rollup(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.coalesce("event_type", F.lit("(none)")).alias("kind")).agg(F.count("*").alias("entries"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("peak"))


_TRIALS = "tr AS (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS trial, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0) / 50, 6) AS sd, round(avg(value) FILTER (event_id % 2 = 0), 6) AS first FROM events WHERE value IS NOT NULL GROUP BY 1)"


@query(
    "reward_gate",
    f"""WITH RECURSIVE {_TRIALS}, o AS (SELECT *, row_number() OVER (ORDER BY trial) AS rn FROM tr WHERE first IS NOT NULL),
    f AS (SELECT rn, trial, 'baseline' AS decision, mean AS im, sd AS isd FROM o WHERE rn = 1
      UNION ALL SELECT o.rn, o.trial, CASE WHEN o.first <= f.im THEN 'discard_early' WHEN o.mean - f.im > greatest(o.sd, f.isd) THEN 'keep' ELSE 'discard' END,
        CASE WHEN o.first > f.im AND o.mean - f.im > greatest(o.sd, f.isd) THEN o.mean ELSE f.im END, CASE WHEN o.first > f.im AND o.mean - f.im > greatest(o.sd, f.isd) THEN o.sd ELSE f.isd END FROM f JOIN o ON o.rn = f.rn + 1)
    SELECT trial, decision, round(im, 6) AS incumbent_mean, round(isd, 6) AS incumbent_sd FROM f""",
)
def reward_gate(spark, d):
    """Days as trials: the gate folds one row per day."""
    rows = table(spark, d, "events").where("value IS NOT NULL")
    day = F.datediff(F.col("ts"), F.lit("2024-01-01")).cast("bigint")
    trials = rows.groupBy(day.alias("trial")).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / 50, 6).alias("sd"), F.round(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))), 6).alias("first"))
    return reports.gate_trials(trials.where("first IS NOT NULL"))


@query(
    "lr_schedule",
    """WITH s AS (SELECT i AS step, CASE WHEN i / 1000.0::DOUBLE < 2 / 3.0::DOUBLE THEN 'stage1' ELSE 'stage2' END AS stage,
      CASE WHEN i / 1000.0::DOUBLE < 2 / 3.0::DOUBLE THEN (i / 1000.0::DOUBLE) / (2 / 3.0::DOUBLE) ELSE (least(i / 1000.0::DOUBLE, 1) - 2 / 3.0::DOUBLE) / (1 - 2 / 3.0::DOUBLE) END AS p FROM range(0, 1201, 3) u(i))
    SELECT step, stage, round(p, 6) AS stage_progress, round(CASE WHEN step <= 50 THEN greatest(step, 1) / 50.0::DOUBLE
      WHEN stage = 'stage1' THEN 1 - least(greatest((p - 0.8) / 0.2, 0), 1) * 0.9 ELSE 1 - least(greatest(p, 0), 1) * 0.9 END, 6) AS multiplier FROM s""",
)
def lr_schedule(spark, d):
    step = F.col("id")
    stage, progress = reports.stage_at(step / F.lit(1000.0), 2 / 3)
    rows = spark.range(0, 1201, 3).select(F.col("id").alias("step"), stage.alias("stage"), progress.alias("p"))
    return rows.select("step", "stage", F.round("p", 6).alias("stage_progress"), F.round(reports.rate_multiplier(F.col("step"), 50, F.col("stage"), F.col("p"), cooldown=0.2), 6).alias("multiplier"))


@query(
    "parameter_count",
    """WITH c AS (SELECT * FROM (VALUES ('layer_norm', 768, 24, 64, false, false, false), ('rms_routed_tied', 768, 24, 64, true, true, true), ('small', 512, 16, 64, false, true, false)) v(name, w, n, k, rms, routed, tied)),
    h AS (SELECT *, ((w * 8) // 3 + 255) // 256 * 256 AS f FROM c)
    SELECT name, (k * w + n * (CASE WHEN rms THEN 0 ELSE 6 * w END + 4 * w * w + 3 * f * w) + CASE WHEN rms THEN 0 ELSE w END + w * w + w + 2 * w + w * k + k + CASE WHEN routed THEN 2 * n ELSE 0 END - CASE WHEN tied THEN k * w ELSE 0 END)::BIGINT AS parameters FROM h""",
)
def parameter_count(spark, d):
    rows = spark.createDataFrame([("layer_norm", 768, 24, 64, False, False, False), ("rms_routed_tied", 768, 24, 64, True, True, True), ("small", 512, 16, 64, False, True, False)], "name string, w bigint, n bigint, k bigint, rms boolean, routed boolean, tied boolean")
    c = F.col
    return rows.select("name", reports.parameter_count(c("w"), c("n"), c("k"), c("rms"), c("routed"), c("tied")).alias("parameters"))


@query(
    "stop_reasons",
    """SELECT event_id, coalesce(CASE WHEN event_id * 7 >= 60000 THEN 'max_model_tokens' END, CASE WHEN event_id >= 8000 THEN 'max_steps' END, CASE WHEN value > 100 THEN 'allocation_deadline' END, CASE WHEN user_id >= 100 THEN 'walltime' END) AS reason FROM events""",
)
def stop_reasons(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", reports.stop_reason(F.col("event_id") * 7, 60000, F.col("event_id"), 8000, F.col("user_id"), 100, F.col("value") > 100).alias("reason"))


@query("stream_ingest_dedup", "SELECT source, split, count(DISTINCT record_id) AS records, sum(length)::BIGINT AS residues FROM (SELECT record_id, any_value(source) AS source, any_value(split) AS split, any_value(length) AS length FROM released_sequences GROUP BY record_id) GROUP BY ALL")
def stream_ingest_dedup(spark, d):
    """An extension: the release as a stream, each record let through once, then summed per source and split."""
    stream = ingest.deduplicated(ingest.table_stream(spark, d, "released_sequences").select("record_id", "source", "split", "length"), "record_id")
    return ingest.drain(stream, "dedup").groupBy("source", "split").agg(F.count("*").alias("records"), F.sum("length").alias("residues"))


@query(
    "event_windows",
    """WITH w AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
    SELECT * FROM w WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
)
def event_windows(spark, d):
    """An extension: tumbling windows over the event stream, put out once the watermark (1 hour) has passed them."""
    stream = ingest.event_windows(ingest.table_stream(spark, d, "events"), "ts", "6 hours", "1 hour")
    done = ingest.drain(stream, "windows")
    return done.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "events", F.round("total", 4).alias("total"))


@query(
    "contact_distances",
    f"""WITH {_PAIRS}, x AS (SELECT chain, CASE WHEN score > 1 THEN 'nan'::DOUBLE ELSE sqrt(2 - 2 * score) END AS d FROM pr)
    SELECT chain, count(*) AS pairs, count(*) FILTER (NOT isnan(d)) AS resolved, count(*) FILTER (NOT isnan(d) AND d < 1.2) AS contacts FROM x GROUP BY chain""",
)
def contact_distances(spark, d):
    """Contacts by distance; pairs whose distance is not a number are unresolved."""
    distance = F.when(F.col("score") > 1, F.lit(float("nan"))).otherwise(F.sqrt(2 - 2 * F.col("score")))
    rows = _pairs(spark, d).withColumn("d", distance)
    return rows.groupBy("chain").agg(F.count("*").alias("pairs"), F.count_if(~F.isnan("d")).alias("resolved"), F.count_if(contacts.contact_flag(F.col("d"), 1.2)).alias("contacts"))


@query(
    "packed_masks",
    f"""WITH {_PAIRS}, o AS (SELECT chain, contact, row_number() OVER (PARTITION BY chain ORDER BY i, j) - 1 AS k FROM pr), b AS (SELECT chain, k // 8 AS byte, sum(contact::INT << (k % 8)::INT)::INT AS v, count(*) AS n FROM o GROUP BY ALL)
    SELECT chain, sum(n)::BIGINT AS n_pairs, string_agg(printf('%02x', v), '' ORDER BY byte) AS bits FROM b GROUP BY chain""",
)
def packed_masks(spark, d):
    return contacts.packed_flags(_pairs(spark, d), "contact")


@query(
    "probe_pipeline",
    f"""WITH {_PAIRS}, z AS (SELECT chain, count(*) AS n FROM pt GROUP BY chain), sc AS (SELECT pr.*, round(0.5 * a.embedding[1]::DOUBLE * b.embedding[1]::DOUBLE - 0.25 * a.embedding[9]::DOUBLE * b.embedding[9]::DOUBLE, 9) AS s
      FROM pr JOIN pt a ON a.chain = pr.chain AND a.pos = pr.i JOIN pt b ON b.chain = pr.chain AND b.pos = pr.j),
    o AS (SELECT sc.chain, contact, n, row_number() OVER (PARTITION BY sc.chain ORDER BY s DESC, i, j) AS rn FROM sc JOIN z ON z.chain = sc.chain)
    SELECT chain, max(n) AS chain_length, round(avg(contact::INT) FILTER (rn <= n), 6) AS precision_at_l, count(*) AS eligible_pair_count, count(*) FILTER (contact) AS contacts FROM o GROUP BY chain""",
)
def probe_pipeline(spark, d):
    """Pairs, a sparse probe score over pair features, and precision at L, in one plan."""
    points = _points(spark, d)
    a = points.select("chain", F.col("pos").alias("i"), F.col("label").alias("la"), F.col("embedding").alias("ea"))
    b = points.select("chain", F.col("pos").alias("j"), F.col("label").alias("lb"), F.col("embedding").alias("eb"))
    feature = lambda k: F.element_at("ea", k).cast("double") * F.element_at("eb", k).cast("double")
    scored = a.join(b, "chain").where("j - i >= 24").select("chain", "i", "j", F.round(0.5 * feature(1) - 0.25 * feature(9), 9).alias("score"), F.coalesce(F.col("la") == F.col("lb"), F.lit(False)).alias("contact"))
    sizes = points.groupBy("chain").agg(F.count("*").alias("chain_length"))
    order = Window.partitionBy("chain").orderBy(F.desc("score"), "i", "j")
    best = scored.join(sizes, "chain").withColumn("rn", F.row_number().over(order))
    top = F.when(F.col("rn") <= F.col("chain_length"), F.col("contact").cast("int"))
    return best.groupBy("chain").agg(F.max("chain_length").alias("chain_length"), F.round(F.avg(top), 6).alias("precision_at_l"), F.count("*").alias("eligible_pair_count"), F.count_if("contact").alias("contacts"))


_UNITS = f"u AS (SELECT DISTINCT split, evaluation_id, {norm('sequence')} AS s FROM evaluation_sequences WHERE sequence IS NOT NULL)"


@query(
    "mask_cache",
    f"""WITH {_UNITS}, o AS (SELECT split, evaluation_id, length(s) AS length, row_number() OVER (ORDER BY length(s), evaluation_id) - 1 AS place FROM u)
    SELECT evaluation_id, split, length, place, place // 16 AS batch, (place // 16) % 4 AS worker FROM o""",
)
def mask_cache(spark, d):
    """The evaluation units in scoring order: by length, then id; batches of 16 dealt to 4 workers."""
    units = table(spark, d, "evaluation_sequences").where("sequence IS NOT NULL").select("split", "evaluation_id", F.length(normalised(F.col("sequence"))).alias("length"), normalised(F.col("sequence")).alias("s")).distinct()
    placed = ranked(units, [], ["length", "evaluation_id"]).withColumn("place", F.col("rn") - 1)
    return placed.select("evaluation_id", "split", "length", "place", F.floor(F.col("place") / 16).alias("batch"), F.pmod(F.floor(F.col("place") / 16), F.lit(4)).alias("worker"))


@query(
    "population_digest",
    f"WITH {_UNITS} SELECT split, count(*) AS units, sha256(string_agg(evaluation_id::VARCHAR || ':' || sha256(s), chr(10) ORDER BY evaluation_id, s)) AS digest FROM u GROUP BY split",
)
def population_digest(spark, d):
    """An order-sensitive digest of each protected population (its size is fixed, not the corpus's)."""
    units = table(spark, d, "evaluation_sequences").where("sequence IS NOT NULL").select("split", "evaluation_id", normalised(F.col("sequence")).alias("s")).distinct()
    listed = F.sort_array(F.collect_list(F.struct("evaluation_id", "s")))
    text = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["evaluation_id"].cast("string"), F.sha2(x["s"], 256))), "\n")
    return units.groupBy("split").agg(F.count("*").alias("units"), F.sha2(text, 256).alias("digest"))


@query(
    "training_arithmetic",
    """WITH c AS (SELECT * FROM (VALUES (768, 24, 170671168, 560000.0), (512, 16, 60000000, 900000.0), (960, 30, 330000000, 300000.0)) v(w, n, p, t))
    SELECT w AS width, n AS layers, round((6e-4::DOUBLE * 512 / w * sqrt(16.0::DOUBLE / n)), 9) AS learning_rate, round(6e-4::DOUBLE * 0.01 / (6e-4::DOUBLE * 512 / w * sqrt(16.0::DOUBLE / n)), 9) AS weight_decay,
           round(6 * p::DOUBLE * t::DOUBLE / (989e12::DOUBLE * 4), 6) AS utilisation FROM c""",
)
def training_arithmetic(spark, d):
    """Transferred rates and model-FLOPs utilisation of three encoder sizes."""
    sizes = spark.createDataFrame([(768, 24, 170671168, 560000.0), (512, 16, 60000000, 900000.0), (960, 30, 330000000, 300000.0)], "width int, layers int, parameters bigint, speed double")
    rate, decay = reports.transferred(F.col("width"), F.col("layers"))
    used = 6 * F.col("parameters") * F.col("speed") / (F.lit(989e12) * 4)
    return sizes.select("width", "layers", F.round(rate, 9).alias("learning_rate"), F.round(decay, 9).alias("weight_decay"), F.round(used, 6).alias("utilisation"))


@query(
    "subset_coverage",
    "WITH e AS (SELECT DISTINCT chain_id FROM evaluation_sequences WHERE chain_id IS NOT NULL), c AS (SELECT DISTINCT chain_id FROM cached_contact_chain) SELECT count(*) AS wanted, count(*) FILTER (chain_id IN (SELECT chain_id FROM c)) AS held, count(*) FILTER (chain_id NOT IN (SELECT chain_id FROM c WHERE chain_id IS NOT NULL)) AS missing FROM e",
)
def subset_coverage(spark, d):
    """How many of the evaluation's chains the scoring cache holds."""
    wanted = table(spark, d, "evaluation_sequences").where("chain_id IS NOT NULL").select("chain_id").distinct()
    held = table(spark, d, "cached_contact_chain").select("chain_id").distinct().withColumn("held", F.lit(True))
    return wanted.join(held, "chain_id", "left").agg(F.count("*").alias("wanted"), F.count("held").alias("held"), F.count_if(F.col("held").isNull()).alias("missing"))


@query("milestone_steps", "SELECT i AS step, i // 250 AS milestone, i % 1000 = 0 OR i = 5000 AS evaluated FROM range(1, 5001) u(i) WHERE i % 250 = 0")
def milestone_steps(spark, d):
    """The steps of a run at which a checkpoint is preserved, and those evaluated."""
    steps = spark.range(1, 5001).where(F.col("id") % 250 == 0)
    return steps.select(F.col("id").alias("step"), F.floor(F.col("id") / 250).alias("milestone"), ((F.col("id") % 1000 == 0) | (F.col("id") == 5000)).alias("evaluated"))
