import random

from strandwork.llm import neardup


def grams(s):
    return {s[i : i + 5] for i in range(len(s) - 4)}


def brute(rows):
    clean = [(c, s.upper().replace(" ", "").rstrip("*")) for c, s in set(rows) if c and s]
    out = set()
    for a, s in clean:
        for b, t in clean:
            if a < b:
                x, y = grams(s), grams(t)
                common = len(x & y)
                if s == t or (common and common >= 0.5 * len(x | y)):
                    out.add((a, b))
    return sorted(out)


def chains(seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=k))
    rows = [("n1", None), ("e1", ""), ("e2", ""), ("s1", "ACD"), ("s2", "acd"), ("s3", "AC"), ("r1", "A" * 40), ("r2", "A" * 60), (None, "ACDEFGH")]
    for f in range(12):
        base = word(rng.choice([40, 120, 300]))
        rows.append((f"f{f}", base))
        for v in range(5):
            s = list(base)
            for _ in range(rng.randrange(1, 14)):
                p = rng.randrange(len(s))
                rng.choice([lambda: s.insert(p, "W"), lambda: s.__setitem__(p, "M"), lambda: s.pop(p)])()
            if rng.random() < 0.4:
                cut = rng.randrange(len(s))
                s = s[cut:] + s[:cut]
            rows.append((f"f{f}v{v}", "".join(s)))
        rows.append((f"f{f}copy", base.lower() + "*"))
    return rows + rows[:20]


def test_pairs_against_brute_force(spark):
    rows = chains(4)
    df = spark.createDataFrame(rows, "chain_id string, sequence string").selectExpr("*", "'x' AS norm", "1 AS k1")
    assert sorted(map(tuple, neardup.near_duplicates(df).collect())) == brute(rows)


def test_groups(spark):
    rows = chains(5)
    got = {r["chain_id"]: (r["group_id"], r["links"]) for r in neardup.duplicate_groups(spark.createDataFrame(rows, "chain_id string, sequence string")).collect()}
    pairs = brute(rows)
    root = {c: c for c, _ in rows if c}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {c: (find(c), sum(c in p for p in pairs)) for c in root}


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 2)
    rows = chains(6)
    assert sorted(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "chain_id string, sequence string")).collect())) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "chain_id string, sequence string")
    assert neardup.near_duplicates(df).count() == 0 and neardup.duplicate_groups(df).count() == 0


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_pruning_bounds():
    steps = neardup.least_matches()
    assert [n for n, _ in steps] == [16, 32, 48, 64] and all(0 <= m < n / 2 for n, m in steps) and steps[-1][1] >= 12


def test_hot_buckets_pair_classes_that_agree_in_one_band(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CHUNK", 2)
    monkeypatch.setattr(neardup, "BLOCK", 2)
    word = bytes(range(neardup.CHECKS))
    # one bucket of all, another of the first four; the last one has other check values and is pruned
    rows = [(k, -k, [7, 8 if k < 4 else 1000 + k] + [100 * k + b for b in range(10000, 10000 + neardup.BANDS - 2)], word) for k in range(9)]
    rows.append((9, -9, [7] + [100 * 9 + b for b in range(20000, 20000 + neardup.BANDS - 1)], word[::-1]))
    got = neardup.candidate_pairs(spark.createDataFrame(rows, "k1 long, k2 long, bands array<long>, checks binary")).collect()
    assert sorted(map(tuple, got)) == [(a, -a, b, -b) for a in range(9) for b in range(a + 1, 9)]


def test_large_groups_of_copies_are_cut_into_parts(spark):
    from strandwork.llm.pairing import pairs_within

    rows = [(g, g + 1, f"c{i:02}") for g, n in enumerate([1, 2, 9, 30]) for i in range(n)]
    for part in (1, 4, 1000):
        got = pairs_within(spark.createDataFrame(rows, "g int, h int, c string"), ["g", "h"], ["c"], part).collect()
        wanted = sorted((a, b) for g in range(4) for x, _, a in rows if x == g for y, _, b in rows if y == g and a < b)
        assert sorted(map(tuple, got)) == wanted


def test_repeated_keys_are_counted_over_all_batches(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD_KEYS", 8)
    rows = [(k, k, [b + 1000 * (k if k % 3 else 0) for b in range(neardup.BANDS)], b"") for k in range(30)]
    signed = spark.createDataFrame(rows, "k1 long, k2 long, bands array<long>, checks binary").repartition(7)
    repeated = neardup.repeated_keys(signed)
    assert sorted(map(tuple, repeated.collect())) == [(b, 10) for b in range(neardup.BANDS)]
    held = neardup.held_bands(signed, repeated)
    assert held.where("k1 % 3 = 0").count() == 10 * neardup.BANDS and held.where("k1 % 3 > 0").count() < 10


def test_bands_miss_few_pairs_at_the_threshold():
    assert (1 - neardup.THRESHOLD**neardup.ROWS) ** neardup.BANDS < 1e-5 and neardup.CHECKS <= neardup.BANDS * neardup.ROWS
    rng = random.Random(2)
    words = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=4000)) for _ in range(2)]
    other = [words[0][:2000] + words[1][:2000], words[0]]
    x, y = (neardup.min_hashes([s]) for s in other)
    agree = float((x == y).mean())
    assert abs(agree - 1 / 3) < 0.06
