"""The queries of this package and their SQL twins.

``queries()`` and ``oracle_sql()`` have the shape of the repository's entry module. Where SQL
can't express an operator (token ids, packing) there is no SQL.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwork.llm import bpe, mixing, neardup, overlap, packing, sampling, spans
from strandwork.runtime import table

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("STRANDWORK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
SAMPLE_RATE = 0.1
SAMPLE_SEED = 20260820


def _p1(function: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: function(table(spark, d, "stages"), table(spark, d, "global_rows"), table(spark, d, "released_sequences"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stable_sample(table(spark, d, "cached_contact_chain"), SAMPLE_RATE, SAMPLE_SEED)


def p2_stability(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample_stability(table(spark, d, "cached_contact_chain"), SAMPLE_RATE, SAMPLE_SEED)


def p2_domain(spark: SparkSession, d: str) -> DataFrame:
    return sampling.domain_check(table(spark, d, "cached_contact_chain"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, d, "cached_contact_chain"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(table(spark, d, "cached_contact_chain"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "evaluation_sequences"), table(spark, d, "released_sequences"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "evaluation_sequences"), table(spark, d, "released_sequences"), table(spark, d, "homology_hits"))


def p4_report_canonical(spark: SparkSession, d: str) -> DataFrame:
    return overlap.canonical_report(table(spark, d, "evaluation_sequences"), table(spark, d, "released_sequences"), table(spark, d, "homology_hits"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return bpe.count_tokens(table(spark, d, "documents"), VOCABULARY)


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_tokens(spark, d), table(spark, d, "stages"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_tokens(spark, d), table(spark, d, "stages"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_check(_tokens(spark, d), table(spark, d, "stages"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), VOCABULARY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p7_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_shares(table(spark, d, "documents"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return spans.without_shared_spans(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": _p1(mixing.shortfalls),
        "p1_mixture": _p1(mixing.mixture_report),
        "p1_draws": _p1(mixing.mixture_draws),
        "p2_sample": p2_sample,
        "p2_stability": p2_stability,
        "p2_domain": p2_domain,
        "p3_found": p3_found,
        "p3_groups": p3_groups,
        "p4_found": p4_found,
        "p4_report": p4_report,
        "p4_report_canonical": p4_report_canonical,
        "p5_ids": p5_ids,
        "p6_pack": p6_pack,
        "p6_report": p6_report,
        "p6_check": p6_check,
        "p7_found": p7_found,
        "p7_shared": p7_shared,
        "p7_clean": p7_clean,
    }


_NEEDS = """
weights AS (
  SELECT DISTINCT name AS stage, e.key AS source, e.value AS weight, budget_residues,
         list_sum(list_filter(map_values(mixture), lambda v: v IS NOT NULL)) AS total
  FROM stages, unnest(map_entries(mixture)) AS u(e) WHERE e.value IS NOT NULL),
needs AS (SELECT stage, source, weight, CASE WHEN total > 0 THEN budget_residues * weight / total END AS need FROM weights),
records AS (
  SELECT record_id, min(source) AS source, coalesce(max(length), 0) AS length FROM released_sequences
  WHERE split = 'train' AND record_id IS NOT NULL AND source IS NOT NULL GROUP BY record_id),
limits AS (
  SELECT stage, source, CASE WHEN coalesce(bool_or(allow_resampling), false) THEN greatest(1, coalesce(max(max_epochs), 1)) ELSE 1 END AS passes
  FROM global_rows GROUP BY stage, source),
demand AS (
  SELECT n.stage, n.source, n.weight, n.need, coalesce(l.passes, 1) AS passes, coalesce(s.residues, 0) AS residues
  FROM needs n LEFT JOIN limits l ON n.stage = l.stage AND n.source = l.source
  LEFT JOIN (SELECT source, sum(length) AS residues FROM records GROUP BY source) s ON n.source = s.source
  WHERE n.need IS NOT NULL)
"""

P1_FOUND = f"WITH {_NEEDS} SELECT stage, source FROM demand WHERE weight > 0 AND residues * passes < need"

_DRAWS = f"""
WITH {_NEEDS},
plan AS (
  SELECT *, CASE WHEN residues > 0 THEN least(passes, floor(need / residues)) ELSE 0 END AS whole FROM demand),
plan2 AS (SELECT *, CASE WHEN whole < passes AND residues > 0 THEN need - whole * residues ELSE 0 END AS rest FROM plan),
ordered AS (
  SELECT *, sum(length) OVER (PARTITION BY source ORDER BY ('0x' || substr(sha256('{mixing.SEED}:' || record_id), 1, 13))::BIGINT, record_id) - length AS before FROM records),
draws AS (
  SELECT p.stage, p.source, o.record_id, o.length, CAST(p.whole + CASE WHEN o.before < p.rest THEN 1 ELSE 0 END AS BIGINT) AS draws
  FROM plan2 p JOIN ordered o ON p.source = o.source)
"""

P1_DRAWS = f"{_DRAWS} SELECT stage, source, record_id, CAST(length AS BIGINT) AS length, draws FROM draws WHERE draws > 0"

P1_MIXTURE = f"""{_DRAWS},
drawn AS (SELECT stage, source, count(*) AS n, sum(draws) AS d, sum(draws * length) AS r FROM draws WHERE draws > 0 GROUP BY 1, 2)
SELECT w.stage, w.source, round(w.weight / nullif(sum(w.weight) OVER (PARTITION BY w.stage), 0), 6) AS target_share,
       CAST(coalesce(n, 0) AS BIGINT) AS records_drawn, CAST(coalesce(d, 0) AS BIGINT) AS draws, CAST(coalesce(r, 0) AS BIGINT) AS residues_drawn,
       round(coalesce(r, 0)::DOUBLE / nullif(sum(coalesce(r, 0)) OVER (PARTITION BY w.stage), 0)::DOUBLE, 6) AS reached_share
FROM weights w LEFT JOIN drawn x ON w.stage = x.stage AND w.source = x.source"""


def p2_sql(rate: float = SAMPLE_RATE, seed: int = SAMPLE_SEED) -> str:
    """The Feistel rounds written out as common table expressions."""
    mask = sampling.MASK
    plain = f"regexp_full_match(chain_id, '[{sampling.ALPHABET}]{{1,{sampling.NUMBERED_LENGTH}}}')"
    parts = [
        "ids AS (SELECT DISTINCT chain_id FROM cached_contact_chain WHERE chain_id IS NOT NULL)",
        f"""numbers AS (SELECT chain_id, CASE WHEN {plain}
            THEN list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(chain_id, '.'), lambda c: instr('{sampling.ALPHABET}', c)::BIGINT)), lambda a, d: a * 64 + d)
            ELSE ('0x' || substr(sha256(chain_id), 1, 15))::BIGINT + {1 << 60} END AS x FROM ids)""",
        f"f0 AS (SELECT chain_id, x >> {sampling.HALF} AS l, x & {mask} AS r FROM numbers)",
    ]
    for i, (a, b) in enumerate(sampling.round_keys(seed)):
        parts.append(f"m{i} AS (SELECT chain_id, l, r, (r * {a} + {b}) >> 15 AS m FROM f{i})")
        parts.append(f"f{i + 1} AS (SELECT chain_id, r AS l, xor(l, ((xor(m, m >> 16) & {mask}) * {a}) >> 13) & {mask} AS r FROM m{i})")
    last = f"f{sampling.ROUNDS}"
    return f"WITH {', '.join(parts)} SELECT chain_id, l * {1 << sampling.HALF} + r AS permuted FROM {last} WHERE l * {1 << sampling.HALF} + r < {int(rate * (1 << 62))}"


def normalised_sql(column: str) -> str:
    """The canonical form of a sequence column in SQL."""
    return f"regexp_replace(rtrim(translate(upper(replace({column}, 'ß', 'SS')), ' ' || chr(9) || chr(10) || chr(13), ''), '*'), '[^ACDEFGHIKLMNPQRSTVWYXBUZO]', 'X', 'g')"


P3_PAIRS = f"""
WITH chains AS (SELECT DISTINCT chain_id, {normalised_sql("sequence")} AS s FROM cached_contact_chain WHERE length(sequence) > 0 AND chain_id IS NOT NULL),
grams AS (SELECT DISTINCT s, substring(s, i::BIGINT, 5) AS g FROM (SELECT DISTINCT s FROM chains), unnest(range(1, length(s) - 3)) AS u(i)),
sizes AS (SELECT s, count(*) AS n FROM grams GROUP BY s),
common AS (SELECT a.s AS x, b.s AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.s < b.s GROUP BY ALL),
alike AS (SELECT x, y FROM common JOIN sizes p ON p.s = x JOIN sizes q ON q.s = y WHERE common.n >= 0.5 * (p.n + q.n - common.n)),
matches AS (SELECT x, y FROM alike UNION ALL SELECT y, x FROM alike UNION ALL SELECT s, s FROM (SELECT DISTINCT s FROM chains)),
pairs AS (
  SELECT DISTINCT a.chain_id AS chain_a, b.chain_id AS chain_b
  FROM matches m JOIN chains a ON a.s = m.x JOIN chains b ON b.s = m.y WHERE a.chain_id < b.chain_id)"""

P3_FOUND = f"{P3_PAIRS} SELECT chain_a, chain_b FROM pairs"

P3_GROUPS = f"""
WITH RECURSIVE {P3_PAIRS.strip().removeprefix("WITH ")},
links AS MATERIALIZED (SELECT chain_a AS x, chain_b AS y FROM pairs UNION ALL SELECT chain_b, chain_a FROM pairs),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
roots AS (SELECT x, min(y) AS root FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS links FROM links GROUP BY x)
SELECT c.chain_id, coalesce(least(root, c.chain_id), c.chain_id) AS group_id, coalesce(degree.links, 0)::BIGINT AS links
FROM (SELECT DISTINCT chain_id FROM cached_contact_chain WHERE chain_id IS NOT NULL) c
LEFT JOIN roots ON roots.x = c.chain_id LEFT JOIN degree ON degree.x = c.chain_id"""

P4_PAIRS = f"""
WITH evaluation AS (
  SELECT DISTINCT evaluation_id AS id, lower(evaluation_sha256) AS sha, {normalised_sql("sequence")} AS s FROM evaluation_sequences
  UNION SELECT DISTINCT record_id, lower(sha256), {normalised_sql("sequence")} FROM released_sequences WHERE split = 'validation'),
train AS (SELECT DISTINCT record_id AS id, lower(sha256) AS sha, {normalised_sql("sequence")} AS s FROM released_sequences WHERE split = 'train'),
e AS (SELECT DISTINCT s, substring(s, i::BIGINT, 5) AS g FROM (SELECT DISTINCT s FROM evaluation), unnest(range(1, length(s) - 3)) AS u(i)),
t AS (SELECT DISTINCT s, substring(s, i::BIGINT, 5) AS g FROM (SELECT DISTINCT s FROM train), unnest(range(1, length(s) - 3)) AS u(i)),
sizes AS (SELECT s, count(*) AS n FROM e GROUP BY s),
near AS (SELECT e.s AS x, t.s AS y FROM e JOIN t ON e.g = t.g JOIN sizes z ON z.s = e.s GROUP BY ALL HAVING count(*) * 5 >= 3 * any_value(z.n)),
pairs AS (
  SELECT a.id AS evaluation_id, b.id AS training_id FROM near JOIN evaluation a ON a.s = x JOIN train b ON b.s = y
  UNION SELECT a.id, b.id FROM evaluation a JOIN train b ON a.sha = b.sha)"""

P4_FOUND = f"{P4_PAIRS} SELECT evaluation_id, training_id FROM pairs"

P4_REPORT = f"""{P4_PAIRS},
sides AS (
  SELECT evaluation_id AS id, 'protected' AS origin, split, NULL AS source, lower(evaluation_sha256) AS sha FROM evaluation_sequences
  UNION ALL SELECT record_id, 'release', split, source, lower(sha256) FROM released_sequences WHERE split = 'validation'),
recs AS (SELECT id, min(origin) AS origin, min(split) AS split, min(source) AS source, min(sha) AS sha FROM sides GROUP BY id),
trains AS (SELECT record_id AS id, min(lower(sha256)) AS sha FROM released_sequences WHERE split = 'train' GROUP BY 1),
claim0 AS (SELECT lower(evaluation_sha256) AS x, lower(training_sha256) AS y, CASE WHEN pident > 1 THEN pident / 100 ELSE pident END AS p FROM homology_hits),
claims AS (SELECT x, y, max(p) AS p FROM (SELECT * FROM claim0 UNION ALL SELECT y, x, p FROM claim0) GROUP BY x, y),
detail AS (SELECT evaluation_id, r.sha AS e, t.sha AS t FROM pairs JOIN recs r ON r.id = evaluation_id JOIN trains t ON t.id = training_id),
per AS (
  SELECT evaluation_id, count(*) AS pairs, count(*) FILTER (e = t) AS exact, count(c.x) AS claimed, sum(c.p) AS ps, count(c.p) AS pn
  FROM detail LEFT JOIN claims c ON c.x = e AND c.y = t GROUP BY evaluation_id)
SELECT origin, split, source, count(*) AS records, count(evaluation_id) AS overlapping_records, coalesce(sum(pairs), 0)::BIGINT AS overlap_pairs,
       coalesce(sum(exact), 0)::BIGINT AS exact_pairs, coalesce(sum(claimed), 0)::BIGINT AS claimed_pairs, round(sum(ps) / nullif(sum(pn), 0), 6) AS claimed_identity
FROM recs LEFT JOIN per ON per.evaluation_id = recs.id GROUP BY origin, split, source"""


P4_REPORT_CANONICAL = f"""{P4_PAIRS},
sides AS (
  SELECT evaluation_id AS id, 'protected' AS origin, split, NULL AS source FROM evaluation_sequences WHERE evaluation_id IS NOT NULL
  UNION ALL SELECT record_id, 'release', split, source FROM released_sequences WHERE split = 'validation' AND record_id IS NOT NULL),
recs AS (SELECT id, min(origin) AS origin, min(split) AS split, min(source) AS source FROM sides GROUP BY id),
ed AS (SELECT id, sha AS h FROM evaluation WHERE sha IS NOT NULL UNION SELECT id, sha256(s) FROM evaluation WHERE s <> ''),
td AS (SELECT id, sha AS h FROM train WHERE sha IS NOT NULL UNION SELECT id, sha256(s) FROM train WHERE s <> ''),
same AS (SELECT DISTINCT a.id AS e, b.id AS t FROM ed a JOIN td b ON a.h = b.h WHERE a.id IS NOT NULL AND b.id IS NOT NULL),
every AS (SELECT evaluation_id AS e, training_id AS t FROM pairs WHERE evaluation_id IS NOT NULL AND training_id IS NOT NULL UNION SELECT e, t FROM same),
claim0 AS (SELECT lower(evaluation_sha256) AS x, lower(training_sha256) AS y, CASE WHEN pident > 1 THEN pident / 100 ELSE pident END AS p FROM homology_hits),
claimed AS (
  SELECT a.id AS e, b.id AS t, max(p) AS p FROM (SELECT * FROM claim0 UNION ALL SELECT y, x, p FROM claim0) c JOIN ed a ON a.h = c.x JOIN td b ON b.h = c.y GROUP BY 1, 2),
per AS (
  SELECT v.e AS id, count(*) AS pairs, count(s.e) AS exact, count(c.e) AS claimed, sum(c.p) AS ps, count(c.p) AS pn
  FROM every v LEFT JOIN same s ON s.e = v.e AND s.t = v.t LEFT JOIN claimed c ON c.e = v.e AND c.t = v.t GROUP BY v.e)
SELECT origin, split, source, count(*) AS records, count(per.id) AS overlapping_records, coalesce(sum(pairs), 0)::BIGINT AS overlap_pairs,
       coalesce(sum(exact), 0)::BIGINT AS exact_pairs, coalesce(sum(claimed), 0)::BIGINT AS claimed_pairs, round(sum(ps) / nullif(sum(pn), 0), 6) AS claimed_identity
FROM recs LEFT JOIN per ON per.id = recs.id GROUP BY origin, split, source"""


P2_DOMAIN = f"""
WITH ids AS (SELECT DISTINCT chain_id, regexp_full_match(chain_id, '[{sampling.ALPHABET}]{{1,{sampling.NUMBERED_LENGTH}}}') AS plain, substr(sha256(chain_id), 1, 15) AS h FROM cached_contact_chain WHERE chain_id IS NOT NULL),
same AS (SELECT h, count(*) AS n FROM ids WHERE NOT plain GROUP BY h HAVING count(*) > 1)
SELECT count(*) AS ids, count(*) FILTER (plain) AS numbered, count(*) FILTER (NOT plain) AS hashed, coalesce((SELECT sum(n) FROM same), 0)::BIGINT AS colliding FROM ids"""


P2_STABILITY = f"""
WITH chosen AS ({p2_sql()}), span AS (SELECT epoch(min(cached_at)) / 2 + epoch(max(cached_at)) / 2 AS m FROM cached_contact_chain),
early AS (SELECT DISTINCT chain_id FROM cached_contact_chain, span WHERE epoch(cached_at) <= m AND chain_id IN (SELECT chain_id FROM chosen))
SELECT (SELECT count(*) FROM chosen) AS selected, count(*) AS early_selected, count(*) AS kept, (SELECT count(*) FROM chosen) - count(*) AS added FROM early"""


_WINDOWS = f"""
windows AS (
  SELECT doc_id, i, hash(substring(text, i::BIGINT, {spans.SPAN})) AS h
  FROM documents, unnest(range(1, greatest(length(text), {spans.SPAN}) - {spans.SPAN} + 2)) AS u(i) WHERE length(text) >= {spans.SPAN})
"""

P7_FOUND = f"""
WITH {_WINDOWS}, held AS (SELECT DISTINCT doc_id, h FROM windows)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id"""

P7_SHARED = f"""
WITH {_WINDOWS}, several AS (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1),
shared AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM windows SEMI JOIN several USING (h)),
covered AS (SELECT doc_id, sum(least({spans.SPAN}, coalesce(following - i, {spans.SPAN}))) AS n FROM shared GROUP BY doc_id)
SELECT d.doc_id, length(text)::BIGINT AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars,
       round(coalesce(n, 0)::DOUBLE / nullif(length(text), 0)::DOUBLE, 6) AS shared_share
FROM documents d LEFT JOIN covered c ON d.doc_id = c.doc_id"""


P7_CLEAN = f"""
WITH {_WINDOWS}, firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (h) WHERE first < doc_id),
breaks AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {spans.SPAN} THEN 0 ELSE 1 END AS fresh FROM gone),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM breaks),
islands AS (SELECT doc_id, min(i) AS b, max(i) + {spans.SPAN} AS e FROM numbered GROUP BY doc_id, island),
sizes AS (SELECT doc_id, sum(e - b) AS removed, max(e) AS last FROM islands GROUP BY doc_id),
pieces AS (
  SELECT doc_id, b, substring(text, previous::BIGINT, (b - previous)::BIGINT) AS piece
  FROM (SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 1) AS previous FROM islands) JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, last, substring(text, last::BIGINT, length(text)) FROM sizes JOIN documents USING (doc_id)),
joined AS (SELECT doc_id, string_agg(piece, '' ORDER BY b) AS text FROM pieces GROUP BY doc_id)
SELECT d.doc_id, length(d.text)::BIGINT AS n_chars, coalesce(removed, 0)::BIGINT AS removed_chars, CASE WHEN removed IS NULL THEN d.text ELSE j.text END AS text
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN joined j ON j.doc_id = d.doc_id"""

P6_CHECK = """
SELECT name AS stage, max(context_length)::INTEGER AS capacity, (SELECT count(*) FROM documents) AS texts,
       (SELECT count(*) FROM documents WHERE coalesce(text, '') = '') AS empty_texts,
       0::BIGINT AS lost_texts, 0::BIGINT AS cut_texts, 0::BIGINT AS overlaps, 0::BIGINT AS overfull
FROM stages WHERE context_length > 0 AND name IS NOT NULL GROUP BY name"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_mixture": P1_MIXTURE,
        "p1_draws": P1_DRAWS,
        "p2_sample": p2_sql(),
        "p2_stability": P2_STABILITY,
        "p2_domain": P2_DOMAIN,
        "p3_found": P3_FOUND,
        "p3_groups": P3_GROUPS,
        "p4_found": P4_FOUND,
        "p4_report": P4_REPORT,
        "p4_report_canonical": P4_REPORT_CANONICAL,
        "p6_check": P6_CHECK,
        "p7_found": P7_FOUND,
        "p7_shared": P7_SHARED,
        "p7_clean": P7_CLEAN,
    }
