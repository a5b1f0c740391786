"""Scoring by batches against BM25 row by row."""

import math
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamstone.operators import evaluation, scoring, search
from loamstone.plans import retrieval

random.seed(3)
WORDS = [f"w{i}" for i in range(40)]
CHUNKS = [(f"d{i % 60}", i // 60, " ".join(random.choice(WORDS) if random.random() < 0.7 else "the" for _ in range(random.randrange(0, 30)))) for i in range(240)] + [("d0", 9, None), ("d1", 9, ""), ("d2", 9, "the the the"), ("d3", 9, "the the the")]
QUERIES = [(1, "the w1 w2"), (1, "the w1 w2"), (2, "the"), (3, "w3 w3 w4"), (4, "nowhere"), (5, ""), (6, None), (7, "W5 the w6 w7 w8 w9")]


def frames(spark, chunks=CHUNKS, queries=QUERIES):
    c = spark.createDataFrame([(*x, "q") for x in chunks], "doc_id string, chunk_idx bigint, chunk_text string, query_id string")
    return spark.createDataFrame(queries, "query_id bigint, query_text string"), scoring.forward_index(c)


def brute(n, allowed=lambda d: True):
    texts = {(d, i): (t or "").split() for d, i, t in CHUNKS}
    df = Counter(w for ws in texts.values() for w in set(ws))
    avg = sum(len(t.split()) for _, _, t in CHUNKS if t is not None) / sum(t is not None for _, _, t in CHUNKS)
    out = set()
    for q, text in dict(QUERIES).items():
        scored = []
        for (d, i), ws in texts.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (len(CHUNKS) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / avg)) for w in (text or "").lower().split() if tf[w])
            if s > 0 and allowed(d):
                scored.append((-round(s, 6), d, i))
        out |= {(q, d, i, -s) for s, d, i in sorted(scored)[:n]}
    return out


@pytest.mark.parametrize("batch,words", [(4096, 500_000), (7, 500_000), (7, 3)])
@pytest.mark.parametrize("n", [1, 5, 1000])
def test_best_chunks(spark, monkeypatch, n, batch, words):
    monkeypatch.setattr(scoring, "BATCH", batch)
    monkeypatch.setattr(scoring, "QUERY_WORDS", words)
    queries, forward = frames(spark)
    got = search.bm25_top(queries, forward, scoring.forward_stats(forward), n).collect()
    assert {(r["query_id"], r["doc_id"], r["chunk_idx"], r["raw_score"]) for r in got} == brute(n) and len(got) == len(brute(n))
    assert all(r["rank"] == 1 and r["score"] == 1 for r in got) if n == 1 else True


@pytest.mark.parametrize("held", [0, 8_000_000])
def test_words_of_every_frequency_and_equal_queries(spark, monkeypatch, held):
    _, forward = frames(spark)
    rows = [r for r in forward.select("doc_id", "chunk_idx", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).toArrow().to_batches()]
    texts = {(r["doc_id"], r["chunk_idx"]): r["tokens"] for b in rows for r in b.to_pylist()}
    weights = [(q, w, 1.0 + 0.01 * i) for q, t in [(1, "the w1 w2"), (2, "the w1 w2"), (3, "w3 w4"), (4, "the"), (5, "nowhere"), (None, "w5")] for i, w in enumerate(t.split())]
    table = pa.table({"query_id": pa.array([w[0] for w in weights], pa.int64()), "term": [w[1] for w in weights], "w": [w[2] for w in weights]})
    monkeypatch.setattr(scoring, "HELD_SCORES", held)
    for size, common, sparse, kept in [(7, 16, 8, 3), (50, 2, 1, 40), (1000, 1000, 1000, 2_000_000)]:
        monkeypatch.setattr(scoring, "COMMON", common)
        monkeypatch.setattr(scoring, "SPARSE", sparse)
        monkeypatch.setattr(scoring, "HELD_ROWS", kept)
        got = {}
        for b in scoring._scored(scoring._of_size(rows, size), scoring._Queries(table), 10.0, 5):
            for r in b.to_pylist():
                got.setdefault(r["query_id"], []).append((-round(r["s"], 6), r["doc_id"], r["chunk_idx"]))
        for q in (1, 2, 3, 4, None):
            parts = [(w, x) for p, w, x in weights if p == q]
            scores = [(-round(sum(x * ws.count(w) * 2.2 / (ws.count(w) + 1.2 * (0.25 + 0.75 * len(ws) / 10.0)) for w, x in parts), 6), *key) for key, ws in texts.items()]
            assert sorted(got[q])[:5] == sorted(s for s in scores if s[0] < 0)[:5] and len(got[q]) == len(set(got[q]))
        assert 5 not in got


def test_what_later_chunks_rule_out_does_not_leave_a_task(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BATCH", 7)
    queries, forward = frames(spark)
    weights = search.query_terms(queries).withColumn("w", F.lit(1.0))
    scored = scoring.best_scored(weights, forward.repartition(1), 10.0, 5).collect()
    for q in (1, 2, 3, 7):
        s = sorted((r["s"] for r in scored if r["query_id"] == q), reverse=True)
        assert s[-1] > s[4] - 1e-4


def test_bootstrap_draws_its_candidates_once(spark, data, monkeypatch):
    calls, best_scored = [], search.best_scored
    monkeypatch.setattr(search, "best_scored", lambda *a: calls.append(a[-1]) or best_scored(*a))
    one = retrieval.bootstrap_ci(spark, data).first()
    assert calls == [40]
    rel = retrieval.judged(spark, data)
    a, b = ({r["query_id"]: r["recall"] for r in evaluation.ranking_metrics(h, rel, 10).collect()} for h in (retrieval.bm25_doc_rank(spark, data), search.documents_of(retrieval.hybrid_alpha_03(spark, data))))
    assert one["mean_delta"] == pytest.approx(sum(b[q] - a[q] for q in a) / len(a), abs=1e-6) and one["low"] <= one["mean_delta"] <= one["high"]


def test_allowed_documents_and_empty_tables(spark):
    queries, forward = frames(spark)
    stats = scoring.forward_stats(forward)
    allowed = spark.createDataFrame([("d1",), ("d2",), ("d2",)], "doc_id string")
    got = search.bm25_top(queries, forward, stats, 5, allowed).collect()
    assert {(r["query_id"], r["doc_id"], r["chunk_idx"], r["raw_score"]) for r in got} == brute(5, lambda d: d in ("d1", "d2"))
    assert search.bm25_top(queries.limit(0), forward, stats, 5).count() == 0
    assert search.bm25_top(queries, forward.limit(0), scoring.forward_stats(forward.limit(0)), 5).count() == 0


def test_postings_and_frequencies_agree_with_the_inverted_index(spark):
    _, forward = frames(spark)
    posts = scoring.forward_postings(forward)
    assert sorted(map(tuple, search.term_stats(posts).collect())) == sorted(map(tuple, scoring.document_frequency(forward).collect()))
    assert {(r["doc_id"], r["chunk_idx"], r["tf"]) for r in posts.filter("term = 'the' and chunk_idx = 9").collect()} == {("d2", 9, 3), ("d3", 9, 3)}
