"""Same or near-same records across splits (problem 4).

Evaluation records (the protected set and the validation split) are held against the train
split. Records are canonicalised (case, white space, trailing marks, foreign characters) and
hashed; evaluation hashes are joined with train hashes, at two grains:

1. *Whole records.* The declared digests, without regard to letter case, and the hashes of the
   canonical sequences.
2. *Grams.* A match must hold ``N`` of the ``D`` distinct ``GRAM``-grams of the evaluation record,
   ``N / D >= SHARE``, so it may miss ``D - N`` of them. Of any ``D - N + c`` grams it holds at least
   ``c``. Each evaluation record therefore enters an index under its ``D - N + c`` rarest grams, and a
   train record is compared with those records that it meets under ``c = MATCHES`` grams or more. This
   holds for any edit: nothing is assumed about runs, blocks or positions. Whoever passes is
   counted exactly, over all grams, in the same task.

Grams are five residues of an alphabet of 25: their code *is* the gram, below ``25^5``. The evaluation
records are the query set. It goes over the train split in *passes* of at most ``PASS_GRAMS`` grams,
broadcast in blocks of about ``BLOCK_GRAMS`` (a pass is closed before its measured size exceeds the bound;
a single record has at most ``25^5`` grams). A pass is one scan of the train split without a
shuffle, whatever gram or record is hot on either side: only true pairs leave it.

"Rarest" is by the number of evaluation classes that hold the gram, for those held by more than one
class in ``FREQUENT`` (there are at most ``FREQUENT`` times the mean size of such grams), and by residue
frequencies for the others. The order only affects the speed.

Records with equal canonical sequences are one class on the evaluation side; members are expanded
last. Null sequences have no grams, null digests no digest match; a sequence shorter than ``GRAM`` matches
by its declared digest only. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwork.functions.hashing import content_key
from strandwork.functions.sequence import RESIDUES, normalised
from strandwork.runtime import fan_out, settle, spread

GRAM = 5
SHARE = (3, 5)  # 0.6 as a fraction
MATCHES = 3
FREQUENT = 1000
BLOCK_GRAMS = 1 << 20
PASS_GRAMS = 1 << 24
BATCH_RESIDUES = 1 << 19
MOST_HITS = 1 << 22
UNIVERSE = len(RESIDUES) ** GRAM

_CODES = np.zeros(256, dtype=np.int32)
for _i, _c in enumerate(RESIDUES):
    _CODES[ord(_c)] = _i


def gram_codes(text: bytes) -> np.ndarray:
    """The code of the gram at every position but the last ``GRAM - 1``."""
    codes = _CODES[np.frombuffer(text, dtype=np.uint8)]
    size = max(0, len(codes) - GRAM + 1)
    out = np.zeros(size, dtype=np.int32)
    for i in range(GRAM):
        out *= len(RESIDUES)
        out += codes[i : i + size]
    return out


def needed(grams: int) -> int:
    """How many of so many distinct grams must be shared."""
    return -(-grams * SHARE[0] // SHARE[1])


def indexed(grams: int) -> tuple[int, int]:
    """How many of a record's grams enter the index, and how often each.

    A record of which fewer than ``MATCHES`` grams are needed enters under them several times, so that
    ``MATCHES`` entries are met in any case.
    """
    asked = min(MATCHES, needed(grams))
    return grams - needed(grams) + asked, -(-MATCHES // max(1, asked))


def contained(evaluation: str, train: str) -> bool:
    """Whether enough of the distinct grams of ``evaluation`` occur in ``train``."""
    own = {evaluation[i : i + GRAM] for i in range(len(evaluation) - GRAM + 1)}
    other = {train[i : i + GRAM] for i in range(len(train) - GRAM + 1)}
    return bool(own) and len(own & other) >= needed(len(own))


def evaluation_side(evaluation: DataFrame, released: DataFrame) -> DataFrame:
    """``eval_id, split, source, digest, sequence`` of the protected records and the validation split."""
    protected = evaluation.select(F.col("evaluation_id").alias("eval_id"), "split", F.lit(None).cast("string").alias("source"), F.lower("evaluation_sha256").alias("digest"), "sequence", F.lit("protected").alias("origin"))
    held = released.where(F.col("split") == "validation").select(F.col("record_id").alias("eval_id"), "split", "source", F.lower("sha256").alias("digest"), "sequence", F.lit("release").alias("origin"))
    return protected.unionByName(held).where(F.col("eval_id").isNotNull())


def train_side(released: DataFrame) -> DataFrame:
    return released.where((F.col("split") == "train") & F.col("record_id").isNotNull())


def record_hashes(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, kind, h1, h2``: a hash of the declared digest (kind 0) and one of the canonical sequence (kind 1) of each record.

    Null digests, and null sequences or ones shorter than a gram, have none.
    """
    def entry(kind: int, value: Column, known: Column) -> Column:
        h1, h2 = content_key(value)
        return F.when(known, F.struct(F.lit(kind).alias("kind"), h1.alias("h1"), h2.alias("h2")))

    named = rows.select(key, F.lower(digest).alias("declared"), normalised(F.col("sequence")).alias("norm"))
    kept = named.select(key, entry(0, F.col("declared"), F.col("declared").isNotNull()).alias("a"), entry(1, F.col("norm"), F.length("norm") >= GRAM).alias("b"))
    return kept.select(key, F.inline(F.filter(F.array("a", "b"), lambda h: h.isNotNull())))


def hash_pairs(evaluation: DataFrame, released: DataFrame) -> DataFrame:
    """``eval_id, record_id`` whose declared digests, or whose canonical sequences, have equal hashes."""
    left = record_hashes(evaluation_side(evaluation, released), "eval_id", "digest").distinct()
    right = record_hashes(train_side(released), "record_id", "sha256")
    return left.join(right, ["kind", "h1", "h2"]).select("eval_id", "record_id")


def evaluation_grams(classes: DataFrame) -> DataFrame:
    """``e1, e2, grams``: the distinct grams of each class. ``classes``: ``e1, e2, norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(gram_codes(s.encode("ascii"))) for s in batch.column(2).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["e1", "e2", "grams"])

    return fan_out(classes.where(F.length("norm") >= GRAM)).mapInArrow(run, "e1 long, e2 long, grams array<int>")


def residue_ranks(frequencies: np.ndarray) -> np.ndarray:
    """The expected frequency of every gram (25^5 of them), in logarithms, from those of the residues."""
    single = np.log(frequencies.astype(np.float64) + 1).astype(np.float32)
    return reduce(lambda a, b: (a[:, None] + b[None, :]).reshape(-1), [single] * GRAM)


def rarest_first(classes: DataFrame, grams: DataFrame, sizes: tuple[int, int]) -> DataFrame:
    """``e1, e2, block, grams``: each class's grams with the rarest first, and its block of the query set."""
    count, total = sizes
    common = grams.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > max(64, count // FREQUENT)).toArrow()
    letters = classes.select(*[F.sum(F.length("norm") - F.length(F.replace("norm", F.lit(c), F.lit("")))).alias(c) for c in RESIDUES]).first()
    frequencies = np.array([x or 0 for x in letters])
    shared = classes.sparkSession.sparkContext.broadcast((frequencies, common.column("gram").to_numpy(), common.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = residue_ranks(shared.value[0])
        ranks[shared.value[1]] = ranks.max(initial=0) + shared.value[2]
        for batch in batches:
            column = batch.column(3)
            values, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
            own = np.repeat(np.arange(len(column)), np.diff(ends))
            order = np.lexsort((values, ranks[values], own))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values[order], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), lists], names=["e1", "e2", "block", "grams"])

    block = F.pmod(F.xxhash64("e1", "e2"), F.lit(-(-total // BLOCK_GRAMS) or 1)).cast("int")
    return fan_out(grams.select("e1", "e2", block.alias("block"), "grams")).mapInArrow(run, "e1 long, e2 long, block int, grams array<int>")


def passes(sizes: dict[int, int], most: int = PASS_GRAMS) -> list[list[int]]:
    """Blocks by pass: each pass takes blocks until the next one would carry it over the bound."""
    out, held = [], 0
    for block in sorted(sizes):
        if not out or held + sizes[block] > most:
            out.append([])
            held = 0
        out[-1].append(block)
        held += sizes[block]
    return out


class GramIndex:
    """The evaluation classes of one pass under their rarest grams, and all their grams."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.e1, self.e2, size, self.grams = (np.concatenate(x) for x in zip(*blocks))
        self.ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        kinds, kind = np.unique(size, return_inverse=True)
        taken, often = np.array([indexed(n) for n in kinds.tolist()]).reshape(-1, 2).T
        taken, often = taken[kind], often[kind]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), taken)
        first = np.arange(len(owner)) - np.repeat(np.cumsum(taken) - taken, taken)
        key = self.grams[self.ends[owner] + first]
        key, owner = np.repeat(key, often[owner]), np.repeat(owner, often[owner])
        order = np.argsort(key, kind="stable")
        self.owner = owner[order]
        count = np.bincount(key, minlength=UNIVERSE)
        self.starts = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
        self.known = count > 0

    def candidates(self, grams: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(record, class)`` that meet under ``MATCHES`` grams or more. Record ``r`` has ``grams[ends[r]:ends[r + 1]]``."""
        out = [np.zeros(0, dtype=np.int64)]
        at = np.flatnonzero(self.known[grams])
        record, gram = np.searchsorted(ends, at, side="right") - 1, grams[at]
        count = self.starts[gram + 1] - self.starts[gram]
        reached = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        begin = 0
        while begin < len(at):
            # whole records, with a bounded number of hits unless one record has more
            end = int(np.searchsorted(reached, reached[begin] + MOST_HITS, side="right")) - 1
            if end < len(at):
                whole = int(np.searchsorted(record, record[end]))
                end = whole if whole > begin else int(np.searchsorted(record, record[begin], side="right"))
            n = count[begin:end]
            place = np.repeat(self.starts[gram[begin:end]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            keys = np.sort(np.repeat(record[begin:end], n) * len(self.e1) + self.owner[place])
            met = keys[MATCHES - 1 :]
            out.append(np.unique(met[met == keys[: len(met)]]))
            begin = end
        found = np.concatenate(out)
        return found // max(1, len(self.e1)), found % max(1, len(self.e1))

    def matches(self, grams: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(record, class)`` for which the record holds enough of the class's grams."""
        record, owner = self.candidates(grams, ends)
        keep = np.zeros(len(record), dtype=bool)
        last, held = -1, None
        for i, (r, e) in enumerate(zip(record.tolist(), owner.tolist())):
            if r != last:
                last, held = r, np.unique(grams[ends[r] : ends[r + 1]])
            own = self.grams[self.ends[e] : self.ends[e + 1]]
            at = np.searchsorted(held, own)
            keep[i] = np.count_nonzero(held[np.minimum(at, len(held) - 1)] == own) >= needed(len(own))
        return record[keep], owner[keep]


_indexes: dict[tuple, GramIndex] = {}


def _index(blocks: list[Broadcast], name: tuple) -> GramIndex:
    """The index of a pass, built once per Python worker; the last one only is kept."""
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = GramIndex([b.value for b in blocks])
    return _indexes[name]


def train_matches(train: DataFrame, blocks: list[Broadcast], name: tuple) -> DataFrame:
    """``record_id, e1, e2``: exact matches of the train rows with the classes of one pass. ``train``: ``record_id, norm``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(blocks, name)
        for batch in batches:
            batch = batch.filter(pc.greater_equal(pc.binary_length(batch.column(1)), GRAM))
            sequences = batch.column(1).to_pylist()
            begin = 0
            while begin < len(sequences):
                size, end = 0, begin
                while end < len(sequences) and (end == begin or size + len(sequences[end]) < BATCH_RESIDUES):
                    size += len(sequences[end])
                    end += 1
                lengths = np.array([len(s) for s in sequences[begin:end]])
                grams = gram_codes("".join(sequences[begin:end]).encode("ascii"))
                inside = np.ones(len(grams), dtype=bool)
                for back in range(1, GRAM):
                    inside[np.cumsum(lengths)[:-1] - back] = False
                record, owner = index.matches(grams[inside], np.concatenate([[0], np.cumsum(lengths - GRAM + 1)]))
                if len(record):
                    ids = batch.column(0).take(pa.array(record + begin))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(index.e1[owner]), pa.array(index.e2[owner])], names=["record_id", "e1", "e2"])
                begin = end

    return spread(train).mapInArrow(run, "record_id long, e1 long, e2 long")


def near_pairs(evaluation: DataFrame, released: DataFrame) -> DataFrame:
    """``eval_id, record_id`` where the train record holds enough of the evaluation record's grams."""
    norm = normalised(F.col("sequence"))
    e1, e2 = content_key(F.col("norm"))
    named = evaluation_side(evaluation, released).where(F.col("sequence").isNotNull()).select("eval_id", norm.alias("norm"))
    side = settle(named.select("eval_id", e1.alias("e1"), e2.alias("e2"), "norm"), "overlap-evaluation")
    classes = side.groupBy("e1", "e2").agg(F.first("norm").alias("norm"))
    grams = settle(evaluation_grams(classes), "overlap-grams")
    count, total = grams.agg(F.count("*"), F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()
    queries = settle(rarest_first(side, grams, (count, total)), "overlap-queries", partition_by="block")
    held = {r["block"]: r["n"] for r in queries.groupBy("block").agg(F.sum(F.size("grams")).alias("n")).collect()}
    train = train_side(released).where(F.col("sequence").isNotNull()).select("record_id", norm.alias("norm"))
    context, label = side.sparkSession.sparkContext, queries.inputFiles()[:1]
    found = []
    for number, blocks in enumerate(passes(held)):
        parts = []
        for block in blocks:
            rows = queries.where(F.col("block") == block).select("e1", "e2", F.size("grams").alias("n"), "grams").toArrow()
            flat = rows.column("grams").combine_chunks()
            flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
            parts.append(context.broadcast((rows.column("e1").to_numpy(), rows.column("e2").to_numpy(), rows.column("n").to_numpy(), flat.flatten().to_numpy())))
        found.append(train_matches(train, parts, (*label, number)))
    if not found:
        return side.select("eval_id", F.col("eval_id").alias("record_id")).where(F.lit(False))
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.join(side.select("eval_id", "e1", "e2").distinct(), ["e1", "e2"]).select("eval_id", "record_id")


def overlaps(evaluation: DataFrame, released: DataFrame) -> DataFrame:
    """``evaluation_id, training_id``: every cross-split overlap, exact or almost, each pair once."""
    pairs = hash_pairs(evaluation, released).unionByName(near_pairs(evaluation, released)).distinct()
    return pairs.select(F.col("eval_id").alias("evaluation_id"), F.col("record_id").alias("training_id"))


def overlap_report(evaluation: DataFrame, released: DataFrame, hits: DataFrame) -> DataFrame:
    """Overlaps per origin, split and source of the evaluation record, beside what an outside search claims.

    ``claimed_pairs``: overlaps for which the hit table has a row, under either order of its
    two digests; ``claimed_identity`` is the mean of the best ``pident`` of each (percent
    turned into fractions, null claims left out). Null sources are a group of their own.
    """
    pairs = settle(overlaps(evaluation, released), "overlap-found")
    records = settle(evaluation_side(evaluation, released).groupBy("eval_id").agg(F.first("origin").alias("origin"), F.min("split").alias("split"), F.min("source").alias("source"), F.min("digest").alias("e_digest")), "overlap-records")
    train = train_side(released).groupBy("record_id").agg(F.min(F.lower("sha256")).alias("t_digest"))
    identity = F.when(F.col("pident") > 1, F.col("pident") / 100).otherwise(F.col("pident"))
    cleaned = hits.select(F.lower("evaluation_sha256").alias("x"), F.lower("training_sha256").alias("y"), identity.alias("identity"))
    claims = cleaned.unionByName(cleaned.select(F.col("y").alias("x"), F.col("x").alias("y"), "identity")).groupBy("x", "y").agg(F.max("identity").alias("identity"))
    detail = (
        pairs.join(records.select(F.col("eval_id").alias("evaluation_id"), "e_digest"), "evaluation_id")
        .join(train.select(F.col("record_id").alias("training_id"), "t_digest"), "training_id")
        .join(claims.select(F.col("x").alias("e_digest"), F.col("y").alias("t_digest"), "identity", F.lit(1).alias("claimed")), ["e_digest", "t_digest"], "left")
    )
    per_record = detail.groupBy("evaluation_id").agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col("e_digest") == F.col("t_digest")).alias("exact"),
        F.count("claimed").alias("claimed"),
        F.sum("identity").alias("identity_sum"),
        F.count("identity").alias("identity_n"),
    )
    return _per_group(records, per_record)


def _per_group(records: DataFrame, per_record: DataFrame) -> DataFrame:
    """The report of ``records`` with the counts of those that overlap."""
    joined = records.join(per_record, records["eval_id"] == per_record["evaluation_id"], "left")
    return joined.groupBy("origin", "split", "source").agg(
        F.count("*").alias("records"),
        F.count("evaluation_id").alias("overlapping_records"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("overlap_pairs"),
        F.coalesce(F.sum("exact"), F.lit(0)).alias("exact_pairs"),
        F.coalesce(F.sum("claimed"), F.lit(0)).alias("claimed_pairs"),
        F.round(F.sum("identity_sum") / F.nullif(F.sum("identity_n"), F.lit(0)), 6).alias("claimed_identity"),
    )


def named_digests(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """``key, digest``: the declared digest of each record and the SHA-256 of its canonical sequence (nulls and empty sequences left out)."""
    norm = normalised(F.col("sequence"))
    computed = F.when(norm != "", F.sha2(norm, 256))
    return rows.select(key, F.explode(F.array_distinct(F.array(F.lower(digest), computed))).alias("digest")).where("digest IS NOT NULL")


def canonical_report(evaluation: DataFrame, released: DataFrame, hits: DataFrame) -> DataFrame:
    """:func:`overlap_report` by canonical content: declared *or* computed digests, on both sides.

    The hashes of the canonicalised records are joined beside the declared ones. A pair is exact
    if any digest of one record is one of the other, and claimed if the hit table names any of them.
    The train side is joined once, for exact pairs and claims together.
    """
    side = settle(evaluation_side(evaluation, released), "canonical-evaluation")
    records = side.groupBy("eval_id").agg(F.first("origin").alias("origin"), F.min("split").alias("split"), F.min("source").alias("source"))
    names = settle(named_digests(side, "eval_id", "digest").distinct(), "canonical-names")
    identity = F.when(F.col("pident") > 1, F.col("pident") / 100).otherwise(F.col("pident"))
    cleaned = hits.select(F.lower("evaluation_sha256").alias("x"), F.lower("training_sha256").alias("y"), identity.alias("identity"))
    claims = cleaned.unionByName(cleaned.select(F.col("y").alias("x"), F.col("x").alias("y"), "identity")).where("y IS NOT NULL").groupBy("x", "y").agg(F.max("identity").alias("identity"))
    claimed = names.withColumnRenamed("digest", "x").join(claims, "x").select("eval_id", F.col("y").alias("digest"), F.lit(False).alias("exact"), F.lit(True).alias("claimed"), "identity")
    equal = names.select("eval_id", "digest", F.lit(True).alias("exact"), F.lit(False).alias("claimed"), F.lit(None).cast("double").alias("identity"))
    matched = equal.unionByName(claimed).join(named_digests(train_side(released), "record_id", "sha256"), "digest")
    matched = matched.select("eval_id", "record_id", F.col("exact").alias("overlap"), "exact", "claimed", "identity")
    found = near_pairs(evaluation, released).select("eval_id", "record_id", F.lit(True).alias("overlap"), F.lit(False).alias("exact"), F.lit(False).alias("claimed"), F.lit(None).cast("double").alias("identity"))
    flags = [F.bool_or(c).alias(c) for c in ("overlap", "exact", "claimed")]
    detail = matched.unionByName(found).groupBy("eval_id", "record_id").agg(*flags, F.max("identity").alias("identity")).where("overlap")
    per_record = detail.groupBy(F.col("eval_id").alias("evaluation_id")).agg(
        F.count("*").alias("pairs"),
        F.count_if("exact").alias("exact"),
        F.count_if("claimed").alias("claimed"),
        F.sum("identity").alias("identity_sum"),
        F.count("identity").alias("identity_n"),
    )
    return _per_group(records, per_record)
