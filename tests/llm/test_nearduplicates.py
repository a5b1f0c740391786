import itertools
import random

import numpy as np

from loamstone.llm import nearduplicates as nd
from loamstone.llm.tokens import TOKEN


def shingles(text):
    t = TOKEN.findall(text.lower())
    return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}


def brute(rows, s):
    sets = {i: shingles(t) for i, t in rows if t is not None and i is not None}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        u = len(sets[a] | sets[b])
        if u and len(sets[a] & sets[b]) * 100 >= s * 100 * u:
            out.add((a, b))
    return out


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                p = rng.randrange(len(words))
                words[p : p + rng.randint(0, 1)] = [rng.choice(vocab)]
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocab, k=rng.randint(3, 120)))))
    return rows


def found(spark, rows, s=0.6):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, a string")
    return sorted(tuple(r) for r in nd.near_duplicate_pairs(df, s).collect())


def test_all_pairs_of_brute_force(spark):
    rows = corpus(300, 4)
    for s in (0.6, 0.8):
        assert found(spark, rows, s) == sorted(brute(rows, s))


def test_copies_nulls_short_and_repeated(spark):
    t = "one two three four five six seven"
    rows = [(5, t), (3, t.upper()), (3, t.upper()), (9, t + " eight"), (1, "one two three four"), (2, "one two three four"), (7, None), (None, t), (8, "")]
    assert found(spark, rows) == sorted(brute(rows, 0.6)) == [(3, 5), (3, 9), (5, 9)]
    assert found(spark, []) == []
    long = " ".join(f"w{i}" for i in range(60_000))
    assert found(spark, [(1, long), (2, long + " tail")]) == [(1, 2)]


def test_hot_block_on_a_grid(spark):
    df = spark.createDataFrame([("k", i) for i in range(70)] + [("l", 1), ("l", 2), ("m", 1)], "key string, item int")
    got = [tuple(r) for r in nd.pairs_within(df, "key", "item", cell=8).collect()]
    assert sorted(got) == sorted([*itertools.combinations(range(70), 2), (1, 2)])


def test_crowded_blocks_lose_no_pair(spark, monkeypatch):
    template = " ".join(f"boiler{i}" for i in range(60))
    rows = [(i, f"{template} {t}") for i, t in corpus(120, 6)]
    want = sorted(brute(rows, 0.6))
    monkeypatch.setattr(nd, "HOT_BLOCK", 3)
    assert found(spark, rows, 0.6) == want and len(want) > 100


def test_rarest_runs_meet_for_every_similar_pair(spark):
    rng = np.random.default_rng(1)
    base = [rng.choice(60, 20, replace=False) for _ in range(6)]
    sets = []
    for i in range(60):
        own = set(base[i % 6].tolist())
        for x in rng.choice(60, rng.integers(0, 8)).tolist():
            own ^= {x}
        sets.append((i, sorted(own)))
    for s in (0.5, 0.6, 0.8, 1.0):
        got = {tuple(r) for r in nd.by_rarest_runs(spark.createDataFrame(sets, "doc_id bigint, shingles array<bigint>"), s).collect()}
        assert {(i, j) for (i, a), (j, b) in itertools.combinations(sets, 2) if len({*a} & {*b}) >= s * len({*a} | {*b}) - 1e-9} <= got


def test_groups_and_links(spark):
    rows = corpus(120, 9) + [(1000, "too short")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in nd.near_duplicate_groups(df, 0.6).collect()}
    assert set(got) == {i for i, _ in rows} and got[1000]["group_id"] == 1000 and got[1000]["links"] == 0
    for a, b in brute(rows, 0.6):
        assert got[a]["group_id"] == got[b]["group_id"]
    sets = {i: frozenset(shingles(t)) for i, t in rows if shingles(t)}
    for a, b in itertools.combinations(sets, 2):
        assert (got[a]["class_id"] == got[b]["class_id"]) == (sets[a] == sets[b])


def test_slots_agree_as_often_as_the_sets_resemble():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    other = np.concatenate([base[:750], rng.integers(0, 2**63, 250, dtype=np.uint64)])
    slots = nd.fingerprints([np.unique(base), np.unique(other)])
    assert abs((slots[0] == slots[1]).mean() - 0.6) < 0.15
    bits = (slots >> np.uint64(11)).astype(np.uint8) & 1
    assert (bits[0] != bits[1]).sum() <= nd.most_differing(0.6)
