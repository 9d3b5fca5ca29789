"""Shared fragments of the SQL twins."""

from __future__ import annotations

from strandwork.functions.sequence import CANONICAL, RESIDUES

# The residue letters in id order from 4 on.
LETTERS = "LAGVSERTIDPKQNFYMHWCXBUZO"


def norm(column: str) -> str:
    """The canonical form of a sequence column."""
    return f"regexp_replace(rtrim(translate(upper(replace({column}, 'ß', 'SS')), ' ' || chr(9) || chr(10) || chr(13), ''), '*'), '[^{RESIDUES}]', 'X', 'g')"


def u52(*parts: str) -> str:
    """The 52-bit hash of SQL expressions joined by colons."""
    return f"('0x' || substr(sha256({' || chr(58) || '.join(f'({p})::VARCHAR' for p in parts)}), 1, 13))::BIGINT"


def key(*parts: str) -> str:
    return f"sha256({' || chr(58) || '.join(f'({p})::VARCHAR' for p in parts)})"


#: r: each record once.
RECORDS = f"""
rec AS (
  SELECT record_id, any_value(source) AS source, any_value(split) AS split, any_value(path) AS path, any_value({norm("sequence")}) AS norm,
         any_value(lower(sha256)) AS sha, any_value(length) AS length, any_value(ingested_at) AS ingested_at
  FROM released_sequences WHERE record_id IS NOT NULL GROUP BY record_id),
r AS (
  SELECT *, sha256(norm) AS digest,
    CASE WHEN norm IS NULL THEN 'missing' WHEN length(norm) < 60 THEN 'short' WHEN length(norm) > 16384 THEN 'long'
         WHEN length(norm) - length(regexp_replace(norm, '[^{CANONICAL}]', '', 'g')) > 0.2 * length(norm) THEN 'ambiguous' END AS rejected,
    CASE WHEN source IS NULL THEN 5 WHEN source = 'uniref90' THEN 0 WHEN source = 'mgnify' THEN 1 WHEN source = 'omg_img' THEN 2 WHEN source = 'esm_atlas' THEN 3 ELSE 4 END AS arm
  FROM rec)"""

PROTECTED = f"""
guarded AS (
  SELECT lower(evaluation_sha256) AS digest FROM evaluation_sequences WHERE evaluation_sha256 IS NOT NULL
  UNION SELECT sha256({norm("sequence")}) FROM evaluation_sequences WHERE sequence IS NOT NULL)"""

HITS = """
hits AS (
  SELECT DISTINCT lower(evaluation_sha256) AS evaluation_digest, lower(training_sha256) AS training_digest FROM homology_hits
  WHERE CASE WHEN pident > 1 THEN pident / 100 ELSE pident END >= 0.30 AND evaluation_coverage >= 0.80 AND training_coverage >= 0.80 AND evalue <= 0.001)"""
