import numpy as np
import pytest

from loamstone.llm import mixing as mx


def test_flight_keeps_both_balances():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 500):
        p, size = rng.uniform(0, 1, n), rng.integers(1, 900, n).astype(float)
        out = mx.flight(p, size, np.random.default_rng(2))
        assert ((out > 0) & (out < 1)).sum() <= 2 and out.min() >= 0 and out.max() <= 1
        assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and (out * size).sum() == pytest.approx((p * size).sum(), rel=1e-6)
    same = mx.flight(np.full(9, 1 / 3), np.ones(9), np.random.default_rng(3))
    assert same.sum() == pytest.approx(3)


def test_every_unit_has_its_probability():
    p, size = np.array([0.2, 0.5, 0.8, 0.5, 0.4, 0.6]), np.array([3.0, 9.0, 4.0, 1.0, 7.0, 5.0])
    hits = sum(mx.flight(p, size, np.random.default_rng(i)) for i in range(3000)) / 3000
    assert np.abs(hits - p).max() < 0.05


def test_landing_keeps_probabilities_and_number():
    p = np.array([0.0, 0.3, 0.6, 1.0, 0.45, 0.15])
    draws = np.array([mx.landing(p, np.random.default_rng(i)) for i in range(4000)])
    assert np.isin(draws, (0.0, 1.0)).all() and np.abs(draws.mean(axis=0) - p).max() < 0.03
    assert set(draws.sum(axis=1)) <= {2.0, 3.0}


@pytest.mark.parametrize("bucket", [8, 4096])
def test_sample_in_buckets(spark, bucket):
    rng = np.random.default_rng(4)
    rows = [("hot" if i % 3 else "cold", i, 0.3, int(rng.integers(1, 400))) for i in range(1200)]
    df = spark.createDataFrame(rows, "g string, id int, p double, n int")
    got = mx.cube_sample(df, ["g"], "id", "p", "n", bucket=bucket).collect()
    sizes = {r[1]: r[3] for r in rows}
    assert len({r["id"] for r in got}) == len(got)
    for g in ("hot", "cold"):
        own = [r for r in rows if r[0] == g]
        drawn = [r["id"] for r in got if r["g"] == g]
        assert abs(len(drawn) - 0.3 * len(own)) <= 1 and abs(sum(sizes[i] for i in drawn) - 0.3 * sum(r[3] for r in own)) <= 800


DOCS = [(i, "tok " * (5 + i % 7), s) for i, s in enumerate([" FS ", "fs", "Fs", "web", "web", None, "", "fs"] * 40)]


def test_mix_report_and_reach(spark):
    docs = spark.createDataFrame([(*d, 1) for d in [*DOCS, DOCS[0]]] + [(None, "x", "fs", 1), (9999, None, "fs", 1)], "doc_id bigint, text string, source string, copies int")
    targets = spark.createDataFrame([(1, "fs", 0.6, 3, 0.5), (1, "web ", 0.4, 1, 0.5), (2, "WEB", 1.0, 2, 1.0), (2, "none", 0.1, 5, 1.0), (2, "WEB", 1.0, 2, 1.0), (None, "fs", 1.0, 1, 1.0)], "mix_id bigint, source string, target_share double, max_repeats int, budget_ratio double")
    for bucket in (16, 2048):
        mix, report = mx.mix_sources(docs, targets, bucket=bucket)
        rep = {(r["mix_id"], r["source"]): r for r in report.collect()}
        total = sum(len(t.split()) for _, t, _ in DOCS)
        size = {s: sum(len(t.split()) for _, t, x in DOCS if (x or "").strip().lower() == s) for s in ("fs", "web")}
        assert set(rep) == {(1, "fs"), (1, "web"), (2, "web"), (2, "none")}
        assert rep[1, "fs"]["available"] == size["fs"] and rep[1, "fs"]["wanted"] == pytest.approx(0.3 * total)
        assert {k for k, r in rep.items() if r["out_of_reach"]} == {(m, s) for (m, s), w, c in (((1, "fs"), 0.3, 3), ((1, "web"), 0.2, 1), ((2, "web"), 1.0, 2), ((2, "none"), 0.1, 5)) if c * size.get(s, 0) < w * total}
        for k in ((1, "fs"), (1, "web")):
            if not rep[k]["out_of_reach"]:
                assert abs(rep[k]["reached"] - rep[k]["wanted"]) < 15
        rows = mix.collect()
        assert max(r["copies"] for r in rows if r["mix_id"] == 2) <= 2
        assert sum(r["tokens"] * r["copies"] for r in rows if (r["mix_id"], r["source"]) == (1, "fs")) == rep[1, "fs"]["reached"]
        shares = [r["actual_share"] for (m, _), r in rep.items() if m == 1]
        assert sum(shares) == pytest.approx(1)


def test_out_of_reach_comes_from_the_draw(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", "fs") for i in range(10)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(1, "fs", 1.0, 2, 2.1), (2, "fs", 1.0, 2, 2.0), (3, "fs", 1.0, 0, 0.1), (4, "gone", 0.5, 3, 1.0)], "mix_id bigint, source string, target_share double, max_repeats int, budget_ratio double")
    out = lambda: {r["mix_id"] for r in mx.mix_sources(docs, targets)[1].collect() if r["out_of_reach"]}
    assert out() == {1, 3, 4}
    monkeypatch.setattr(mx, "cube_sample", lambda units, by, key, *_: units.select(*by, key).limit(0))
    targets = targets.replace(2.1, 1.95)
    assert out() == {3, 4}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(1, "fs", 1.0, 2, 1.0)], "mix_id bigint, source string, target_share double, max_repeats int, budget_ratio double")
    mix, report = mx.mix_sources(docs, targets)
    assert mix.count() == 0 and report.first()["reached"] == 0 and not report.first()["out_of_reach"]
    assert mx.mix_sources(docs, targets.limit(0))[1].count() == 0
