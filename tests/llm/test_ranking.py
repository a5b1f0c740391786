import numpy as np
import pytest
from pyspark.sql import functions as F

from loamstone.llm import ranking as rk

ARMS = ["lexical", "dense", "usage"]
HITS = "query_id bigint, doc_id bigint, chunk_idx bigint, arm string, raw_score double, fused double"


def hits(spark, rows):
    return spark.createDataFrame([(*r, 0.0) for r in rows], HITS)


def fuse(spark, rows, **kw):
    return rk.fused_ranking(hits(spark, rows), "query_id", ["doc_id", "chunk_idx"], "arm", "raw_score", ARMS, **kw)


def test_no_arm_rules_by_its_range(spark):
    rows = []
    for doc, (a, b, c) in enumerate([(9.0, 0.9, 1e6), (8.0, 0.8, 9e5), (1.0, 0.1, 2e6)]):
        rows += [(1, doc, 0, arm, s) for arm, s in zip(ARMS, (a, b, c))]
    assert rk.best_item(fuse(spark, rows), "query_id", ["doc_id", "chunk_idx"]).first()["doc_id"] == 0


def test_declared_weights_missing_null_and_nan(spark):
    rows = [(1, 1, 0, "lexical", 5.0), (1, 2, 0, "lexical", 1.0), (1, 2, 0, "dense", 0.9), (1, 1, 0, "dense", None), (1, 2, 0, "usage", float("nan")), (1, 1, 0, "usage", 3.0), (1, 1, 0, "usage", 3.0), (None, 1, 0, "usage", 3.0)]
    params = spark.createDataFrame([(1, 1.0), (2, 0.0)], "query_id bigint, dense_alpha float")
    top = lambda alpha: rk.best_item(fuse(spark, rows, weights=rk.alpha_weights(spark.createDataFrame([(1, alpha)], "query_id bigint, dense_alpha float"))), "query_id", ["doc_id", "chunk_idx"]).collect()
    assert [r["doc_id"] for r in top(1.0)] == [1] and [r["doc_id"] for r in top(None)] == [1]
    assert [r["doc_id"] for r in top(0.0)] == [1]  # equal in rank sums, so the smaller document
    assert fuse(spark, rows, weights=rk.alpha_weights(params)).count() == 2
    assert fuse(spark, []).count() == 0


@pytest.mark.parametrize("limit", [10_000, 40])
def test_ranks_with_ties_whatever_the_group_bound(spark, limit):
    rng = np.random.default_rng(1)
    values = [(int(g), float(v)) for g, v in zip(rng.choice([1, 2], 600, p=[0.9, 0.1]), rng.integers(0, 60, 600))]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "id int, g int, v double")
    got = {r["id"]: r["footing"] for r in rk.rank_transform(df, ["g"], "v", limit).collect()}
    for i, (g, v) in enumerate(values):
        own = [x for h, x in values if h == g]
        assert got[i] == pytest.approx((sum(x < v for x in own) + sum(x == v for x in own) / 2) / len(own))


def test_component_follows_the_declared_direction(spark):
    rng = np.random.default_rng(2)
    t = rng.normal(size=500)
    x = np.stack([t + rng.normal(size=500) * 0.3, t + rng.normal(size=500) * 0.3, -t + rng.normal(size=500) * 0.3], axis=1)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    loadings, matrix = rk.first_component(df, ["a", "b", "c"], [1, 1, -1])
    want = np.linalg.eigh(np.corrcoef(x.T))[1][:, -1]
    assert np.allclose(np.abs(loadings), np.abs(want), atol=1e-6) and loadings[0] > 0 and loadings[2] < 0 and np.allclose(matrix, np.corrcoef(x.T))
    same = df.select(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))
    assert np.allclose(rk.first_component(same, ["a", "b"], [1, 1])[0], [0.5**0.5] * 2)
