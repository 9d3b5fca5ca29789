import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import spans


def brute_pairs(rows, span):
    held = {}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            held.setdefault(t[k : k + span], set()).add(i)
    return sorted({(a, b) for s in held.values() for a in s for b in s if a < b})


def brute_shared(rows, span):
    held = {}
    for i, t in rows:
        for k in range(len(t or "") - span + 1):
            held.setdefault(t[k : k + span], set()).add(i)
    return {i: sum(any(len(held[t[k : k + span]]) > 1 for k in range(max(0, p - span + 1), min(p, len(t) - span) + 1)) for p in range(len(t))) if t else 0 for i, t in rows}


def corpus(seed, n=40):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choices("abcdefgh é😀", k=k))
    shared = [text(rng.choice([199, 200, 201, 350])) for _ in range(6)]
    boiler = text(190)
    rows = [(1000, None), (1001, ""), (1002, "-" * 900), (1003, "-" * 450 + text(40)), (1004, "ab" * 300), (1005, "ab" * 150 + text(10)), (1006, shared[0] * 3), (1007, "x" * 199)]
    for i in range(n):
        parts = [text(rng.randrange(0, 300)) for _ in range(3)]
        rows.append((i, parts[0] + (rng.choice(shared) if rng.random() < 0.6 else "") + parts[1] + (boiler if rng.random() < 0.7 else "") + parts[2]))
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1])]
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 48), (2, 3)])
def test_pairs_and_shares_against_brute_force(spark, seed, shard, monkeypatch):
    monkeypatch.setattr(spans, "SHARD", shard)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    assert sorted(map(tuple, spans.shared_pairs(df).collect())) == brute_pairs(rows, 200)
    got = {r["doc_id"]: r["shared_chars"] for r in spans.shared_shares(df).collect()}
    assert got == brute_shared(rows, 200)


def test_hot_shards_take_the_exact_way(spark):
    rows = corpus(3)
    texts = spans.keyed_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    usual = spans.span_members(texts).select("k1", "begin", "end").distinct().count()
    exact = spans.span_members(texts, shard=1)
    assert usual > 0 and exact.count() > 0
    a = exact.select("c1", "c2", F.col("k1").alias("x")).distinct()
    b = exact.select("c1", "c2", F.col("k1").alias("y")).distinct()
    pairs = a.join(b, ["c1", "c2"]).where("x < y").select("x", "y").distinct().count()
    distinct = {t for _, t in rows if t}
    wanted = brute_pairs(list(enumerate(sorted(distinct))), 200)
    assert pairs == len(wanted)


def test_repeated_rows_and_empty_table(spark):
    t = "abcdefghij" * 25
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (3, "z")], "doc_id long, text string")
    assert list(map(tuple, spans.shared_pairs(df).collect())) == [(1, 2)]
    assert spans.shared_pairs(df.limit(0)).count() == 0 and spans.shared_shares(df.limit(0)).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "a", "abcdefgh"])
def test_every_window_keeps_an_anchor(alphabet):
    rng = random.Random(9)
    texts = ["".join(rng.choices(alphabet, k=k)) for k in (199, 200, 600, 1500)] + ["ab" * 400]
    ends = np.cumsum([len(t) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    at, value = spans.anchor_positions(points, starts, ends)
    hashes = spans.gram_hashes(points, spans.ANCHOR) >> np.uint64(1)
    assert (hashes[at] == value).all()
    for a, b in zip(starts, ends):
        for s in range(a, b - 200 + 1):
            inside = (at >= s) & (at <= s + 72)
            assert inside.any() and value[inside].min() == hashes[s : s + 73].min()


def test_shard_spans_of_maximal_matches():
    shared = "0123456789" * 21
    out = spans.shard_spans(["abc" + shared + "def", "xy" + shared + "z", "q" * 230])
    assert [(h, i, b, e) for h, i, b, e in out] == [(3, 0, 3, 213), (3, 1, 2, 212)]


def brute_clean(rows, span):
    first = {}
    for i, t in sorted((i, t or "") for i, t in rows):
        for k in range(len(t) - span + 1):
            first.setdefault(t[k : k + span], i)
    out = {}
    for i, t in rows:
        gone = {p for k in range(len(t or "") - span + 1) if first[t[k : k + span]] < i for p in range(k, k + span)}
        out[i] = None if t is None else "".join(c for p, c in enumerate(t) if p not in gone)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_removal_keeps_the_first_holder(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash")).withColumn("begin", F.lit(1))
    got = spans.without_shared_spans(df).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_clean(rows, 200)
    assert all(r["removed_chars"] == (r["n_chars"] or 0) - len(r["text"] or "") for r in got)
    assert spans.without_shared_spans(df.limit(0)).count() == 0
