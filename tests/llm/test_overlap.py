import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandwork.llm import overlap

REL = "record_id long, source string, split string, sequence string, sha256 string"
EV = "evaluation_id long, split string, sequence string, evaluation_sha256 string"


def clean(s):
    return None if s is None else s.upper().replace(" ", "").rstrip("*")


def brute(evaluation, released):
    left = [(i, clean(s), h) for i, _, s, h in evaluation] + [(i, clean(s), h) for i, _, p, s, h in released if p == "validation"]
    out = set()
    for i, s, h in left:
        for j, _, p, t, g in released:
            if p == "train":
                exact = h is not None and g is not None and h.lower() == g.lower()
                if exact or (s is not None and t is not None and overlap.contained(s, clean(t))):
                    out.add((i, j))
    return sorted(out)


def tables(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=k))
    evaluation, released = [], []
    low = ["A" * 90, "AC" * 60, "ACDEF" * 20, "A" * 5, "ACD", "", None, "AAAAAACCCCCC"]
    for k in range(40):
        s = low[k] if k < len(low) else word(rng.choice([20, 33, 60, 150, 400]))
        side = (k + 1, "test", s, rng.choice([None, f"h{k}", f"H{k}"]))
        if k % 2:
            evaluation += [side, side]
        else:
            released.append((k + 1, rng.choice(["a", None]), "validation", s, side[3]))
        for v in range(6):
            t = list(s or word(80))
            for _ in range(rng.randrange(0, max(1, len(t) // 9))):
                p = rng.randrange(len(t))
                rng.choice([lambda: t.insert(p, rng.choice("ACDW")), lambda: t.__setitem__(p, "M"), lambda: t.pop(p)])()
            if rng.random() < 0.5 and len(t) > 12:
                cuts = sorted(rng.sample(range(1, len(t)), min(len(t) // 11, 9)))
                parts = [t[a:b] for a, b in zip([0, *cuts], [*cuts, len(t)])]
                rng.shuffle(parts)
                t = [c for part in parts for c in part]
            body = word(rng.choice([0, 0, 50])) + "".join(t) + word(rng.choice([0, 30]))
            row = (1000 + 10 * k + v, rng.choice(["a", "b", None]), "train", rng.choice([body, body.lower() + "*", None if v == 5 else body]), rng.choice([None, f"h{k}", "zz"]))
            released += [row, row] if v == 0 else [row]
    return evaluation, released


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_against_brute_force(spark, seed):
    evaluation, released = tables(seed)
    e = spark.createDataFrame(evaluation, EV).withColumn("norm", F.lit("clash"))
    r = spark.createDataFrame(released, REL).withColumn("k1", F.lit(1)).withColumn("digest", F.lit("clash"))
    got = sorted(map(tuple, overlap.overlaps(e, r).collect()))
    assert got == brute(evaluation, released)


def test_empty(spark):
    e, r = spark.createDataFrame([], EV), spark.createDataFrame([], REL)
    hits = spark.createDataFrame([], "evaluation_sha256 string, training_sha256 string, pident double")
    assert overlap.overlaps(e, r).count() == 0 and overlap.overlap_report(e, r, hits).count() == 0


def test_index_finds_every_match_of_a_record():
    for grams in range(1, 60):
        taken, often = overlap.indexed(grams)
        missing = grams - overlap.needed(grams)
        assert taken <= grams and (taken - missing) * often >= overlap.MATCHES


def test_a_stretch_held_by_most_records(spark):
    rng = random.Random(8)
    word = lambda k: "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=k))
    common = word(24)
    evaluation = [(k, "test", common + word(150), None) for k in range(4)]
    released = [(100 + k, "a", "train", e[2][:120] + word(20), None) for k, e in enumerate(evaluation)] + [(200 + k, "a", "train", word(40) + common + word(90), None) for k in range(30)]
    got = overlap.overlaps(spark.createDataFrame(evaluation, EV), spark.createDataFrame(released, REL))
    assert sorted(map(tuple, got.collect())) == brute(evaluation, released) == [(k, 100 + k) for k in range(4)]


@pytest.mark.parametrize("bounds", [(1 << 6, 1 << 8, 1 << 22), (1 << 9, 1 << 30, 1)])
def test_several_passes_blocks_and_strips(spark, monkeypatch, bounds):
    for name, value in zip(("BLOCK_GRAMS", "PASS_GRAMS", "MOST_HITS"), bounds):
        monkeypatch.setattr(overlap, name, value)
    monkeypatch.setattr(overlap.passes, "__defaults__", (bounds[1],))
    evaluation, released = tables(4)
    evaluation, released = evaluation[:14], released[:90]
    got = overlap.overlaps(spark.createDataFrame(evaluation, EV), spark.createDataFrame(released, REL))
    assert sorted(map(tuple, got.collect())) == brute(evaluation, released)


def test_passes_respect_their_bound():
    assert overlap.passes({0: 5, 1: 4, 2: 3, 3: 20, 4: 1}, 9) == [[0, 1], [2], [3], [4]] and overlap.passes({}, 9) == []


def doubled(s):
    """One residue of every eight repeated: each insertion breaks three grams, or none in a run."""
    return "".join(c * 2 if i % 8 == 4 else c for i, c in enumerate(s))


def pieces(s):
    """Pieces of seven residues, one from every five, joined by a foreign one."""
    return "X".join(s[i : i + 7] for i in range(0, len(s), 5))


def single_grams(s):
    """Every gram that is needed, alone, in another order: no six residues in a row are shared."""
    held = [s[i : i + 5] for i in range(len(s) - 4)]
    return "X".join(reversed(held[: overlap.needed(len(set(held)))]))


@pytest.mark.parametrize("change", [doubled, pieces, single_grams])
def test_changes_that_leave_no_long_stretch(spark, change):
    rng = random.Random(12)
    evaluation = [(k, "test", "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=n)), None) for k, n in enumerate([80, 87, 100, 102, 120, 160, 202, 240, 302, 602])]
    released = [(100 + k, "a", "train", change(s), None) for k, _, s, _ in evaluation]
    got = overlap.overlaps(spark.createDataFrame(evaluation, EV), spark.createDataFrame(released, REL))
    wanted = brute(evaluation, released)
    assert sorted(map(tuple, got.collect())) == wanted and len(wanted) >= 5


def test_equal_canonical_records_without_equal_digests(spark):
    word = "".join(random.Random(3).choices("ACDEFGHIKLMNPQRSTVWY", k=80))
    evaluation = [(1, "test", word.lower() + "*", None), (2, "test", None, "AB"), (3, "test", "acd", None), (4, "test", "WWWWW", "ab")]
    released = [(10, None, "train", word[:40] + "\n" + word[40:], "cd"), (11, "a", "train", "ACD", None), (12, "a", "train", None, "aB"), (13, "a", "train", "wwwww", "zz"), (14, "a", "validation", word, None)]
    e, r = spark.createDataFrame(evaluation, EV), spark.createDataFrame(released, REL)
    assert sorted(map(tuple, overlap.hash_pairs(e, r).distinct().collect())) == [(1, 10), (2, 12), (4, 12), (4, 13), (14, 10)]
    assert sorted(map(tuple, overlap.overlaps(e, r).collect())) == [(1, 10), (2, 12), (4, 12), (4, 13), (14, 10)]


def test_canonical_report_counts_equal_sequences_without_equal_digests(spark):
    word = "".join(random.Random(3).choices("ACDEFGHIKLMNPQRSTVWY", k=80))
    digest = hashlib.sha256(word.encode()).hexdigest()
    evaluation = [(1, "test", word, None), (2, "test", "ACD", "raw"), (3, "test", None, digest.upper()), (4, "test", "", None)]
    released = [(10, "a", "train", word.lower() + "*", "raw spelling"), (11, "a", "train", "a cd", None), (12, "a", "train", "*", None), (13, "a", "train", word[:70] + "W" * 10, "near")]
    hits = spark.createDataFrame([("near", digest, 80.0), (digest, "near", 0.9), ("raw", "elsewhere", 0.5)], "evaluation_sha256 string, training_sha256 string, pident double")
    rows = overlap.canonical_report(spark.createDataFrame(evaluation, EV), spark.createDataFrame(released, REL), hits).collect()
    # 1 and 10, 2 and 11, 3 and 10 are exact; 1 and 13 overlap and are claimed, by the computed digest of 1
    assert [tuple(r) for r in rows] == [("protected", "test", None, 4, 3, 4, 3, 1, 0.9)]


def test_edits_across_block_boundaries(spark):
    rng = random.Random(11)
    evaluation, released = [], []
    for k, size in enumerate([100, 240, 500, 992]):
        s = "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=size))
        t = list(s)
        for p in range(7, size - 1, 16):
            t[p], t[p + 1] = ("W" if c != "W" else "M" for c in t[p : p + 2])
        evaluation.append((k, "test", s, None))
        released.append((100 + k, "a", "train", "".join(t), None))
        # each aligned block holds an edited residue
        assert not any(s[i : i + 8] in released[-1][3] for i in range(0, size - 7, 8))
    got = overlap.overlaps(spark.createDataFrame(evaluation, EV), spark.createDataFrame(released, REL))
    assert sorted(map(tuple, got.collect())) == brute(evaluation, released) == [(k, 100 + k) for k in range(4)]
