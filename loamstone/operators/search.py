"""BM25 search, filters and blending with vectors, for whole sets of queries at once.

A search of one query is the one-row case. Scores are rounded to six places before they are ranked, and
every order is total (score, document, chunk), so that results do not depend on how sums were parallelised.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone import limits
from loamstone.functions.columns import all_of, cosine_unit
from loamstone.functions.exact import canonical_json
from loamstone.functions.text import index_tokens
from loamstone.operators.scoring import K1, B, best_scored, document_frequency, forward_index, forward_postings
from loamstone.session import materialise

PLACES = 6
#: A blend of rounded scores needs more places, or its ties would fall on halves.
BLEND_PLACES = 9


def postings(chunks: DataFrame) -> DataFrame:
    """(term, doc_id, chunk_idx, tf, dl): how often each chunk has each of its tokens, and its length."""
    return forward_postings(forward_index(chunks))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row (n_chunks, avgdl). Chunks without tokens count."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(index_tokens("chunk_text"))).alias("avgdl"))


def term_stats(posts: DataFrame) -> DataFrame:
    """(term, df): chunks that have the term."""
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) from (query_id, query_text); repeated words weigh more. Queries without
    tokens have no rows, repeated query rows count once."""
    q = queries.select("query_id", "query_text").distinct()
    return q.select("query_id", F.explode(index_tokens("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def tf_norm(tf: Column, dl: Column, avgdl: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25_many(queries: DataFrame, posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, doc_id, chunk_idx, raw_score) of every chunk that has a word of the query.

    Document frequencies are counted for the queries' words only, so postings are read behind a semi-join
    on the term; the sum by (query, chunk) is partially aggregated before its shuffle.
    """
    terms = query_terms(queries)
    wanted = posts.join(terms.select("term").distinct(), "term", "left_semi")
    df = term_stats(wanted)
    n, avgdl = stats.first()  # two numbers
    weight = terms.join(df, "term").select("query_id", "term", (idf(F.lit(float(n or 0)), F.col("df")) * F.col("qtf")).alias("w"))
    hits = wanted.join(weight, "term").select("query_id", "doc_id", "chunk_idx", (F.col("w") * tf_norm(F.col("tf"), F.col("dl"), F.lit(float(avgdl or 1.0)))).alias("s"))
    return hits.groupBy("query_id", "doc_id", "chunk_idx").agg(F.round(F.sum("s"), PLACES).alias("raw_score"))


def bm25_top(queries: DataFrame, forward: DataFrame, stats: DataFrame, n: int, allowed: DataFrame | None = None) -> DataFrame:
    """The ``n`` best chunks of each query as :func:`top_candidates` gives them, from a forward index (see
    :mod:`loamstone.operators.scoring`). Of a table ``allowed`` (doc_id) only those documents are ranked, while
    words are weighed by the whole index."""
    terms = query_terms(queries)
    count, avgdl = stats.first()  # two numbers
    weights = terms.join(document_frequency(forward, terms), "term").select("query_id", "term", (idf(F.lit(float(count or 0)), F.col("df")) * F.col("qtf")).alias("w"))
    ranked = forward if allowed is None else forward.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    scored = best_scored(materialise(weights), ranked, float(avgdl or 1.0), n)
    return top_candidates(scored.select("query_id", "doc_id", "chunk_idx", F.round("s", PLACES).alias("raw_score")), n)


def top_candidates(scored: DataFrame, n: Column | int, score: str = "raw_score") -> DataFrame:
    """The best ``n`` chunks of each query with ``rank`` (1 is best) and ``score``, the raw score over the
    query's best, 0 if that is not positive. ``n`` may be a column."""
    w = W.partitionBy("query_id").orderBy(F.col(score).desc(), "doc_id", "chunk_idx")
    pool = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    best = F.max(score).over(W.partitionBy("query_id"))
    return pool.withColumn("score", F.when(best > 0, F.round(F.col(score) / best, PLACES)).otherwise(F.lit(0.0)))


@dataclass
class SearchFilter:
    """Conditions on a document, all of which must hold. Values are compared as canonical JSON."""

    where_eq: dict = field(default_factory=dict)
    where_in: dict = field(default_factory=dict)
    created_after: datetime | None = None
    created_before: datetime | None = None

    def condition(self, metadata: str = "metadata", created_at: str = "created_at", raw: bool = False) -> Column:
        """The filter as a column; missing keys and null times do not match. ``raw``: metadata values are
        plain strings rather than JSON."""
        value = (lambda v: F.lit(v)) if raw else (lambda v: F.lit(canonical_json(v)))
        get = lambda k: F.try_element_at(F.col(metadata), F.lit(k))
        parts = [F.coalesce(get(k) == value(v), F.lit(False)) for k, v in self.where_eq.items()]
        for k, vs in self.where_in.items():
            parts.append(F.coalesce(get(k).isin(*[value(v) for v in vs]), F.lit(False)) if vs else F.lit(False))
        seconds = F.unix_seconds(F.col(created_at).cast("timestamp"))
        if self.created_after is not None:
            parts.append(F.coalesce(seconds >= int(self.created_after.timestamp()), F.lit(False)))
        if self.created_before is not None:
            parts.append(F.coalesce(seconds <= int(self.created_before.timestamp()), F.lit(False)))
        return all_of(parts)

    def active(self) -> bool:
        return bool(self.where_eq or self.where_in or self.created_after is not None or self.created_before is not None)


def search_many(
    queries: DataFrame,
    forward: DataFrame,
    stats: DataFrame,
    k: int,
    docs: DataFrame | None = None,
    where: Column | None = None,
    mode: str = "post",
    exclude: DataFrame | None = None,
    alpha: float = 1.0,
    vectors: DataFrame | None = None,
    query_vectors: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best chunks of each query: (query_id, doc_id, chunk_idx, raw_score, score, rank).

    ``forward`` and ``stats`` are a forward index and its corpus figures. ``where`` is a condition on ``docs``. In mode ``post`` it is applied to the best ``4k`` candidates (at
    most 1024), so fewer than ``k`` may be left; in mode ``pre`` to all chunks first. ``exclude`` has
    documents to leave out, (query_id, doc_id) or doc_id alone. With ``alpha`` under 1 the candidates are
    ranked by alpha * score + (1 - alpha) * cosine of ``vectors`` (doc_id, embedding) and ``query_vectors``
    (query_id, embedding); where either is missing the cosine counts 0.5.
    """
    k = limits.top_k(k)
    alpha = limits.alpha(alpha)
    blend = alpha < 1.0
    if blend and query_vectors is None:
        raise limits.InvalidQuery("dense_alpha under 1 needs query vectors")
    allowed = docs.filter(where).select("doc_id") if where is not None and mode == "pre" else None
    after = (where is not None and mode == "post") or exclude is not None or blend
    pool = bm25_top(queries, forward, stats, limits.fetch_limit(k, after), allowed)
    if where is not None and mode == "post":
        pool = pool.join(docs.filter(where).select("doc_id").distinct(), "doc_id", "left_semi")
    if exclude is not None:
        pool = pool.join(exclude, [c for c in ("query_id", "doc_id") if c in exclude.columns], "left_anti")
    if blend:
        pool = blended(pool, alpha, vectors, query_vectors)
        order = [F.col("score").desc(), F.col("rank")]
    else:
        order = [F.col("rank")]
    return cut_and_rank(pool, k, order)


def blended(pool: DataFrame, alpha: float, vectors: DataFrame | None, query_vectors: DataFrame) -> DataFrame:
    """Candidates with ``score`` mixed with the cosine; vectors are joined for candidates only."""
    qv = query_vectors.select("query_id", F.col("embedding").alias("_q"))
    out = pool.join(qv, "query_id", "left")
    if vectors is None:
        out = out.withColumn("_d", F.lit(None).cast("array<float>"))
    else:
        out = out.join(vectors.select("doc_id", F.col("embedding").alias("_d")), "doc_id", "left")
    mixed = alpha * F.col("score") + (1 - alpha) * cosine_unit(F.col("_q"), F.col("_d"))
    return out.withColumn("score", F.round(mixed, BLEND_PLACES)).drop("_q", "_d")


def cut_and_rank(pool: DataFrame, k: Column | int, order: list[Column]) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*order, "doc_id", "chunk_idx")
    out = pool.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("query_id", "doc_id", "chunk_idx", "raw_score", "score", "rank")


def documents_of(hits: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, doc_id, chunk_idx, score, rank): each document by its best chunk, ranked anew."""
    first = W.partitionBy("query_id", "doc_id").orderBy("rank")
    best = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    out = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    out = out.select("query_id", "doc_id", "chunk_idx", "score", "rank")
    return out if k is None else out.filter(F.col("rank") <= k)


def minmax_rerank(hits: DataFrame, vectors: DataFrame, query_vectors: DataFrame, alpha: float, pool: int = 50, keep: int = 20) -> DataFrame:
    """Another blend: the raw scores of the best ``pool`` are spread to [0, 1] by their extremes (all 0 if
    they span less than 1e-6) and mixed with the cosine; the best ``keep`` are returned."""
    w = W.partitionBy("query_id")
    some = hits.filter(F.col("rank") <= pool)
    low, high = F.min("raw_score").over(w), F.max("raw_score").over(w)
    spread = some.withColumn("score", F.when(high - low >= 1e-6, (F.col("raw_score") - low) / (high - low)).otherwise(F.lit(0.0)))
    mixed = blended(spread, alpha, vectors, query_vectors)
    return cut_and_rank(mixed, keep, [F.col("score").desc(), F.col("rank")])
