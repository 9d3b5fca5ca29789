"""Corpus funnel: records, quality, ownership, protection, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwork.functions.sequence import normalised, rejection
from strandwork.runtime import settle

# Source arms in ownership order; further sources follow by name, null last.
ARMS = ["uniref90", "mgnify", "omg_img", "esm_atlas"]
# Thresholds of the outside homology search.
MIN_IDENTITY, MIN_COVERAGE, MAX_EVALUE = 0.30, 0.80, 0.001


def arm_rank(source: Column) -> Column:
    """Ordinal of a source arm; 4 for other sources, 5 for null."""
    known = F.array_position(F.array(*[F.lit(a) for a in ARMS]), source) - 1
    return F.when(source.isNull(), 5).when(known >= 0, known).otherwise(4).cast("int")


def records(released: DataFrame, split: str | None = None) -> DataFrame:
    """Each record once, with its normalised sequence and digest.

    ``record_id, source, split, path, norm, norm_length, digest, rejected, sha, length``;
    identical repeated rows collapse. ``digest`` is the SHA-256 of the normalised sequence (null
    for null), ``rejected`` its first failing rule, ``sha`` the declared digest in lower case.
    Everything is derived before the rows are grouped, so a query that doesn't use ``norm``
    never shuffles a sequence.
    """
    rows = released if split is None else released.where(F.col("split") == split)
    norm = rows.where(F.col("record_id").isNotNull()).withColumn("norm", normalised(F.col("sequence")))
    derived = norm.select("record_id", "source", "split", "path", "norm", F.length("norm").alias("norm_length"), F.sha2("norm", 256).alias("digest"), rejection(F.col("norm")).alias("rejected"), F.lower("sha256").alias("sha"), "length")
    return derived.dropDuplicates(["record_id"])


def quality_ledger(rows: DataFrame) -> DataFrame:
    """Counts per source and in total by first failing rule."""
    reason = F.coalesce("rejected", F.lit("eligible"))
    tagged = rows.select(F.coalesce("source", F.lit("(none)")).alias("source"), reason.alias("reason"))
    kinds = ["missing", "short", "long", "ambiguous", "eligible"]
    counted = tagged.rollup("source").agg(F.count("*").alias("records"), *[F.count_if(F.col("reason") == k).alias(k) for k in kinds])
    return counted.withColumn("source", F.coalesce("source", F.lit("(all)")))


def owners(rows: DataFrame) -> DataFrame:
    """One row per digest of the eligible records: owner, copies and sources.

    The owner has the first arm, then the least id. ``min`` over a struct combines on the map
    side, so a digest held by very many records needs no window over them.
    """
    eligible = rows.where("rejected IS NULL")
    first = F.min(F.struct(arm_rank(F.col("source")).alias("r"), F.coalesce("source", F.lit("")).alias("s"), F.col("record_id").alias("id"), F.col("source").alias("source")))
    return (
        eligible.groupBy("digest")
        .agg(first.alias("o"), F.count("*").alias("copies"), F.countDistinct(F.coalesce("source", F.lit("(none)"))).alias("sources"))
        .select("digest", F.col("o.id").alias("owner_id"), F.col("o.source").alias("owner_source"), "copies", "sources")
    )


def memberships(rows: DataFrame) -> DataFrame:
    """How many digests and records each combination of sources holds (nulls as ``(none)``)."""
    per = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.array_join(F.sort_array(F.collect_set(F.coalesce("source", F.lit("(none)")))), "+").alias("sources"), F.count("*").alias("n"))
    return per.groupBy("sources").agg(F.count("*").alias("digests"), F.sum("n").alias("records"))


def protected_digests(evaluation: DataFrame) -> DataFrame:
    """Distinct digests of the protected records: declared ones and those of their normalised sequences."""
    declared = evaluation.select(F.lower("evaluation_sha256").alias("digest"))
    computed = evaluation.select(F.sha2(normalised(F.col("sequence")), 256).alias("digest"))
    return declared.unionByName(computed).where("digest IS NOT NULL").distinct()


def clean_hits(hits: DataFrame) -> DataFrame:
    """Distinct hits that pass the thresholds; percent identities become fractions, null ones fail."""
    identity = F.when(F.col("pident") > 1, F.col("pident") / 100).otherwise(F.col("pident"))
    passing = (identity >= MIN_IDENTITY) & (F.col("evaluation_coverage") >= MIN_COVERAGE) & (F.col("training_coverage") >= MIN_COVERAGE) & (F.col("evalue") <= MAX_EVALUE)
    return hits.where(passing).select(F.lower("evaluation_sha256").alias("evaluation_digest"), F.lower("training_sha256").alias("training_digest")).distinct()


def funnel(released: DataFrame, evaluation: DataFrame, hits: DataFrame) -> DataFrame:
    """``record_id, source, norm_length, reason`` for each train record; the first matching reason counts.

    Order: quality rules, duplicate of an owner, protected digest, homology hit, validation
    digest; otherwise ``kept``. Marks arrive by joins on the digest: the protected set and the
    hits are small beside the corpus, and AQE picks broadcast or shuffle by their size. Rejected records
    (all those without a sequence) need no marks and take no part in the joins; records without a declared
    digest get a key of their own, so that they don't meet in one task.
    """
    rows = settle(records(released, "train").select("record_id", "source", "norm_length", "rejected", "digest", "sha"), "funnel")
    held = owners(rows).select("digest", "owner_id")
    guarded = protected_digests(evaluation).withColumn("guarded", F.lit(True))
    similar = clean_hits(hits).select(F.col("training_digest").alias("sha")).distinct().withColumn("similar", F.lit(True))
    validation = records(released, "validation").where("digest IS NOT NULL").select("digest").distinct().withColumn("validation", F.lit(True))
    own = F.coalesce("sha", F.concat(F.lit("none:"), F.col("record_id").cast("string")))
    eligible = rows.where("rejected IS NULL").withColumn("sha", own)
    marked = eligible.join(held, "digest", "left").join(guarded, "digest", "left").join(validation, "digest", "left").join(similar.where("sha IS NOT NULL"), "sha", "left")
    reason = (
        F.when(F.col("owner_id") != F.col("record_id"), "duplicate")
        .when(F.col("guarded"), "protected_exact")
        .when(F.col("similar"), "protected_homology")
        .when(F.col("validation"), "validation")
        .otherwise("kept")
    )
    judged = marked.select("record_id", "source", "norm_length", reason.alias("reason"))
    return judged.unionByName(rows.where("rejected IS NOT NULL").select("record_id", "source", "norm_length", F.col("rejected").alias("reason")))


def funnel_ledger(released: DataFrame, evaluation: DataFrame, hits: DataFrame) -> DataFrame:
    """Records and residues per source (and in total) and reason; the reasons add up to the input."""
    rows = funnel(released, evaluation, hits).withColumn("source", F.coalesce("source", F.lit("(none)")))
    counted = rows.groupBy("source", "reason").agg(F.count("*").alias("records"), F.coalesce(F.sum("norm_length"), F.lit(0)).alias("residues"))
    both = settle(counted, "ledger")
    return both.unionByName(both.groupBy(F.lit("(all)").alias("source"), "reason").agg(F.sum("records").alias("records"), F.sum("residues").alias("residues")))


def first_k(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` digests of each source (a limit that is the operator itself).

    The literal bound plans a group limit before the shuffle.
    """
    distinct = rows.where("digest IS NOT NULL AND source IS NOT NULL").groupBy("source", "digest").agg(F.min("record_id").alias("record_id"))
    order = Window.partitionBy("source").orderBy("digest")
    return distinct.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("source", "rn", "digest", "record_id")


def validation_set(released: DataFrame, evaluation: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """:func:`first_k` of the validation records that the quality rules, ownership and decontamination leave.

    The quality rules are stricter than the storage filter of 32 to 16,384 residues, which they include.
    """
    rows = settle(records(released, "validation").select("record_id", "source", "rejected", "digest", "sha"), "validation")
    held = owners(rows).select(F.col("owner_id").alias("record_id"))
    similar = clean_hits(hits).select(F.col("training_digest").alias("sha")).where("sha IS NOT NULL").distinct()
    kept = rows.where("rejected IS NULL").join(held, "record_id", "left_semi").join(protected_digests(evaluation), "digest", "left_anti").join(similar, "sha", "left_anti")
    return first_k(kept, k)


def overlaps_of_splits(released: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Sizes and intersections of the digest sets of the train, validation and protected records."""
    digests = records(released).where("digest IS NOT NULL").select("digest", F.col("split").alias("part")).unionByName(protected_digests(evaluation).withColumn("part", F.lit("protected")))
    per = digests.groupBy("digest").agg(*[F.bool_or(F.col("part") == p).alias(p) for p in ("train", "validation", "protected")])
    both = lambda a, b: F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}")
    return per.agg(F.count_if("train").alias("train"), F.count_if("validation").alias("validation"), F.count_if("protected").alias("protected"), both("train", "validation"), both("train", "protected"), both("validation", "protected"))


def accession_class(accession: Column) -> Column:
    """The origin of an accession: ``img``, ``mgnify_origin``, ``missing`` (null) or ``unclassified``."""
    return F.when(accession.isNull(), "missing").when(accession.rlike("^([0-9]{7,}|Ga|IMG|JGI)"), "img").when(accession.rlike("^(ERZ|ERR|ERS|ERP|MGY)"), "mgnify_origin").otherwise("unclassified")


def excluding_origin(rows: DataFrame, accession: str = "accession", strict: bool = False) -> DataFrame:
    """``rows`` with ``class`` and ``kept`` (not of the excluded origin). ``strict``: an accession of no known class fails the build."""
    kind = accession_class(F.col(accession))
    if strict:
        kind = F.when(kind == "unclassified", F.raise_error(F.concat(F.lit("unclassified accession: "), F.col(accession)))).otherwise(kind)
    return rows.withColumn("class", kind).withColumn("kept", F.col("class") != "mgnify_origin")
