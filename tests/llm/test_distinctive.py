import math
from collections import Counter

import numpy as np
import pytest

from loamstone.llm import distinctive as ds
from loamstone.llm.tokens import TOKEN


def tail(total, marked, drawn, seen):
    """Exactly, by whole numbers."""
    low, high = max(0, drawn + marked - total), min(marked, drawn)
    ways = sum(math.comb(marked, k) * math.comb(total - marked, drawn - k) for k in range(max(seen, low), high + 1))
    return ways / math.comb(total, drawn)


def test_log_gamma():
    x = np.array([1.0, 1.5, 2.0, 7.3, 100.0, 1e6])
    assert np.allclose(ds.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("case", [(100, 10, 20, 0), (100, 10, 20, 1), (100, 10, 20, 2), (100, 10, 20, 9), (100, 10, 20, 10), (50, 50, 20, 20), (10, 8, 7, 5), (5000, 40, 300, 12), (5000, 900, 300, 20), (1, 1, 1, 1)])
def test_upper_tail(case):
    got = ds.upper_tail(*[np.array([v]) for v in case])[0]
    assert math.exp(got) == pytest.approx(tail(*case), rel=1e-9)


ROWS = [(1, "river river river stone the the"), (2, "the stone cloud the"), (3, "the sky the cloud river"), (3, "the sky the cloud river"), (4, None), (5, ""), (None, "river"), (6, "Ünïcode ünïcode ünïcode 漢字 tab_1 tab_1 tab_1 a12 a12 a12"), (7, "ünïcode")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id bigint, text string, term string, df int")


def test_scores_against_brute_force(spark):
    texts = {i: TOKEN.findall(t.lower()) for i, t in ROWS if t and i is not None}
    cf, df = Counter(t for ts in texts.values() for t in ts), Counter(t for ts in texts.values() for t in set(ts))
    total = sum(cf.values())
    got = {(r["doc_id"], r["term"]): r for r in ds.distinctive_terms(frame(spark)).collect()}
    assert set(got) == {(i, t) for i, ts in texts.items() for t in ts}
    for i, ts in texts.items():
        own = Counter(ts)
        p = {t: tail(total, cf[t], len(ts), n) for t, n in own.items()}
        order = sorted(own, key=lambda t: (got[i, t]["log_p"], t))
        for k, t in enumerate(order):
            r = got[i, t]
            assert (r["tf"], r["df"], r["cf"], r["doc_tokens"]) == (own[t], df[t], cf[t], len(ts)) and math.exp(r["log_p"]) == pytest.approx(p[t], rel=1e-9)
            q = min(1.0, min(p[u] * len(own) / (j + 1) for j, u in enumerate(order) if j >= k))
            assert 10 ** -r["score"] == pytest.approx(q, rel=1e-6)


def test_characteristic_words(spark):
    filler = [(100 + i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(40)]
    scored = ds.distinctive_terms(frame(spark, [*ROWS, *filler]), least_tf=3)
    assert {tuple(r) for r in ds.characteristic(scored).collect()} == {(1, "river"), (6, "ünïcode")}
    assert {r["tf"] >= 3 for r in scored.collect()} == {True}
    # The adjusted score decides: with other scores there are other rows.
    assert ds.characteristic(scored.withColumn("score", scored.score * 0)).count() == 0


def test_small_counts_are_not_enriched_by_chance(spark):
    rows = [(i, "alpha alpha alpha beta gamma") for i in range(2)]  # no term is in one more than in the other
    assert ds.characteristic(ds.distinctive_terms(frame(spark, rows))).count() == 0


def test_log_factorial():
    k = np.array([0.0, 1, 2, 170, 4095, 4096, 1e6, 3e9])
    assert np.allclose(ds.log_factorial(k), [math.lgamma(v + 1) for v in k], rtol=1e-13, atol=1e-13)


def test_top_terms_and_empty(spark):
    top = ds.top_terms(ds.distinctive_terms(frame(spark)), 1)
    assert {r["doc_id"]: r["term"] for r in top.collect()}[1] == "river"
    assert ds.distinctive_terms(frame(spark, [])).count() == 0


@pytest.mark.parametrize("held", [1, 3, 8])
def test_held_and_rare_terms_take_different_ways_to_the_same_scores(spark, held):
    every = sorted(map(tuple, ds.distinctive_terms(frame(spark)).collect()))
    assert sorted(map(tuple, ds.distinctive_terms(frame(spark), held_terms=held).collect())) == every
