"""Queries of chunking, search, rounds and evaluation."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone import limits
from loamstone.functions.columns import cosine_unit
from loamstone.functions.text import CHUNK_WORD, INDEX_TOKEN, contains_answer, plain_query
from loamstone.operators import chunking, evaluation, interleave, query_syntax, scoring, search
from loamstone.plans.registry import query
from loamstone.session import materialise, read_table

# -- parts shared by several queries ---------------------------------------------------------------


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").filter("text is not null")


def chunks(spark: SparkSession, d: str, size: int = chunking.CHUNK_SIZE) -> DataFrame:
    return chunking.chunk_documents(documents(spark, d).select("doc_id", "text"), size)


def searches(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "search_params").select("query_id", "query_text")


def index(spark: SparkSession, d: str, size: int = chunking.CHUNK_SIZE) -> tuple[DataFrame, DataFrame]:
    """The forward index, written once, and its corpus figures."""
    forward = materialise(scoring.forward_index(chunks(spark, d, size)))
    return forward, scoring.forward_stats(forward)


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Document and query vectors: documents and queries are numbered from 1000 and 500."""
    e = read_table(spark, d, "embeddings")
    return e.select((F.col("vec_id") + 1000).alias("doc_id"), "embedding"), e.select((F.col("vec_id") + 500).alias("query_id"), "embedding")


def judged(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "chunk_hits").filter("arm = 'dense' and raw_score > 0.5").select("query_id", "doc_id").distinct()


CHUNKS = f"""chunks as (
  select doc_id, i - 1 as chunk_idx, c[i] as chunk_text from (
    select doc_id, regexp_extract_all(text, '{chunking.chunk_pattern(64).replace("'", "''")}') as c from documents where text is not null), unnest(range(1, len(c) + 1)) as u(i))"""


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '{INDEX_TOKEN}'), lambda x: strlen(x) < 40)"


INDEX = f"""{CHUNKS},
toks as (select doc_id, chunk_idx, {_tokens('chunk_text')} as t from chunks),
posts as (select term, doc_id, chunk_idx, dl, count(*) as tf from (select doc_id, chunk_idx, len(t) as dl, unnest(t) as term from toks) group by all),
stats as (select count(*) as n_chunks, avg(len(t)) as avgdl from toks),
dfs as (select term, count(*) as df from posts group by term)"""


def _bm25(queries: str) -> str:
    return f"""{INDEX},
qterms as (select query_id, term, count(*) as qtf from (select query_id, unnest({_tokens('query_text')}) as term from (select distinct * from ({queries}))) group by all),
bm25 as (
  select query_id, doc_id, chunk_idx, round(sum(qtf * ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as raw_score
  from qterms join posts using (term) join dfs using (term), stats group by all)"""


BM25 = _bm25("select query_id, query_text from search_params")


def _pool(n: int, source: str = "bm25", name: str = "pool") -> str:
    return f"""{name} as (
  select *, case when max(raw_score) over (partition by query_id) > 0 then round(raw_score / max(raw_score) over (partition by query_id), 6) else 0 end as score from (
    select *, row_number() over (partition by query_id order by raw_score desc, doc_id, chunk_idx) as rank from {source} qualify rank <= {n}))"""


def _cut(k: int, source: str, order: str = "rank") -> str:
    return f"""select query_id, doc_id, chunk_idx, raw_score, score, new_rank as rank from (
  select *, row_number() over (partition by query_id order by {order}, doc_id, chunk_idx) as new_rank from {source} qualify new_rank <= {k})"""


HITS = f"with {BM25}, {_pool(10)} {_cut(10, 'pool')}"
DOCS_OF = """docs_of as (
  select query_id, doc_id, chunk_idx, score, row_number() over (partition by query_id order by rank) as rank from (
    select * from hits qualify row_number() over (partition by query_id, doc_id order by rank) = 1))"""

# -- chunking --------------------------------------------------------------------------------------


@query(f"with {CHUNKS} select *, len(regexp_extract_all(chunk_text, '{CHUNK_WORD.replace(chr(39), chr(39) * 2)}')) as token_count from chunks")
def chunks_64(spark, d):
    return chunks(spark, d)


@query(f"""with c as (select doc_id, regexp_extract(text, '{chunking.WHOLE.replace(chr(39), chr(39) * 2)}') as c from documents where text is not null)
select doc_id, 0 as chunk_idx, c as chunk_text, len(regexp_extract_all(c, '{CHUNK_WORD.replace(chr(39), chr(39) * 2)}')) as token_count from c where c <> ''""")
def one_chunk_documents(spark, d):
    return chunking.one_chunk_documents(documents(spark, d).select("doc_id", "text"))


@query(f"""with c as (select doc_id, regexp_extract_all(text, '{chunking.chunk_pattern(96).replace("'", "''")}') as c from documents where text is not null)
select doc_id, i - 1 as chunk_idx, c[i] as chunk_text, len(regexp_extract_all(c[i], '{CHUNK_WORD.replace(chr(39), chr(39) * 2)}')) as token_count from c, unnest(range(1, len(c) + 1)) as u(i)""")
def chunks_96(spark, d):
    return chunks(spark, d, 96)


@query(f"""with {CHUNKS}, n as (select doc_id, len(regexp_extract_all(chunk_text, '{CHUNK_WORD.replace(chr(39), chr(39) * 2)}')) as token_count from chunks)
select count(*) as chunks, count(distinct doc_id) as documents, sum(token_count) as tokens, max(token_count) as longest from n""")
def chunk_stats(spark, d):
    return chunks(spark, d).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct("doc_id").alias("documents"), F.sum("token_count").alias("tokens"), F.max("token_count").alias("longest"))


@query()
def chunks_overlap(spark, d):
    docs = documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return chunking.chunk_documents_exact(docs, 64, 16)


@query("""with w as (select doc_id, regexp_extract_all(text, '[A-Za-z]+') as w from documents where text is not null),
c as (select doc_id, w, k - 1 as k, (k - 1) * 48 as a, least((k - 1) * 48 + 64, len(w)) as b from w, unnest(range(1, len(w) // 48 + 2)) as u(k) where (k - 1) * 48 < len(w) and (k = 1 or (k - 2) * 48 + 64 < len(w))),
t as (select *, array_to_string(w[a + 1:b], ' ') as chunk_text, case when a = 0 then 0 else length(array_to_string(w[1:a], ' ')) + 1 end as s from c)
select doc_id::varchar as doc_id, k as chunk_idx, chunk_text, s as char_start, s + length(chunk_text) as char_end, s as byte_start, s + length(chunk_text) as byte_end, b - a as token_count from t""")
def chunks_overlap_words(spark, d):
    """Overlapping chunks of the texts' plain words, which both engines take for words."""
    plain = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), " ")
    return chunking.chunk_documents_exact(documents(spark, d).select(F.col("doc_id").cast("string").alias("doc_id"), plain.alias("text")), 64, 16)


@query(f"with {INDEX} select term, df from dfs")
def term_stats(spark, d):
    return scoring.document_frequency(scoring.forward_index(chunks(spark, d)))


@query(f"with {INDEX} select n_chunks, round(avgdl, 6) as avgdl from stats")
def corpus_stats(spark, d):
    return search.corpus_stats(chunks(spark, d)).withColumn("avgdl", F.round("avgdl", 6))


# -- search ----------------------------------------------------------------------------------------


@query(HITS)
def bm25_topk(spark, d):
    return search.search_many(searches(spark, d), *index(spark, d), 10)


@query(f"with hits as ({HITS}), {DOCS_OF} select * from docs_of")
def bm25_doc_rank(spark, d):
    return search.documents_of(bm25_topk(spark, d))


_NOTES = search.SearchFilter(where_eq={"kind": "note"})
_EXTS = search.SearchFilter(where_in={"ext": ["md", "txt"]})
_SINCE, _UNTIL = datetime(2030, 7, 1, tzinfo=timezone.utc), datetime(2031, 6, 30, 12, tzinfo=timezone.utc)
_WHEN = search.SearchFilter(created_after=_SINCE, created_before=_UNTIL)


def _filtered(spark, d, where: search.SearchFilter, mode: str):
    return search.search_many(searches(spark, d), *index(spark, d), 10, documents(spark, d), where.condition(raw=True), mode)


@query(f"with {BM25}, {_pool(40)}, kept as (select p.* from pool p join documents using (doc_id) where metadata['kind'] = 'note') {_cut(10, 'kept')}")
def bm25_filter_eq_post(spark, d):
    return _filtered(spark, d, _NOTES, "post")


@query(f"with {BM25}, fit as (select b.* from bm25 b join documents using (doc_id) where metadata['ext'] in ('md', 'txt')), {_pool(10, 'fit')} {_cut(10, 'pool')}")
def bm25_filter_in_pre(spark, d):
    return _filtered(spark, d, _EXTS, "pre")


@query(f"""with {BM25}, {_pool(40)}, kept as (
  select p.* from pool p join documents using (doc_id) where floor(epoch(created_at)) between {int(_SINCE.timestamp())} and {int(_UNTIL.timestamp())}) {_cut(10, 'kept')}""")
def bm25_filter_date(spark, d):
    return _filtered(spark, d, _WHEN, "post")


def _used(spark, d):
    return read_table(spark, d, "chunk_hits").filter("arm = 'usage' and query_id is not null").select("query_id", "doc_id").distinct()


@query(f"with {BM25}, {_pool(40)}, kept as (select p.* from pool p where not exists (select 1 from chunk_hits h where arm = 'usage' and h.query_id = p.query_id and h.doc_id = p.doc_id)) {_cut(10, 'kept')}")
def bm25_exclude(spark, d):
    return search.search_many(searches(spark, d), *index(spark, d), 10, exclude=_used(spark, d))


_COS = """coalesce(case when sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double))) > 0 then
  greatest(0, least(1, (list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: z[1]::double * z[2]::double)) /
    (sqrt(list_sum(list_transform(q.embedding, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(v.embedding, lambda x: x::double * x::double)))) + 1) / 2)) end, 0.5)"""
_WITH_COS = "left join embeddings v on v.vec_id + 1000 = p.doc_id left join embeddings q on q.vec_id + 500 = p.query_id"


def _hybrid_sql(alpha: float) -> str:
    return f"with {BM25}, {_pool(40)}, mixed as (select p.* replace (round({alpha} * score + {1 - alpha} * {_COS}, 9) as score) from pool p {_WITH_COS}) {_cut(10, 'mixed', 'score desc, rank')}"


def _hybrid(spark, d, alpha: float):
    dv, qv = vectors(spark, d)
    return search.search_many(searches(spark, d), *index(spark, d), 10, alpha=alpha, vectors=dv, query_vectors=qv)


@query(_hybrid_sql(0.3))
def hybrid_alpha_03(spark, d):
    return _hybrid(spark, d, 0.3)


@query(_hybrid_sql(0.0))
def hybrid_alpha_00(spark, d):
    return _hybrid(spark, d, 0.0)


@query(f"""with {BM25}, {_pool(50)}, spread as (
  select *, max(raw_score) over (partition by query_id) as hi, min(raw_score) over (partition by query_id) as lo from pool),
mixed as (select p.query_id, doc_id, chunk_idx, raw_score, rank, round(0.5 * case when hi - lo >= 1e-6 then (raw_score - lo) / (hi - lo) else 0 end + 0.5 * {_COS}, 9) as score from spread p {_WITH_COS})
{_cut(20, 'mixed', 'score desc, rank')}""")
def dense_minmax_rerank(spark, d):
    pool = search.bm25_top(searches(spark, d), *index(spark, d), 50)
    return search.minmax_rerank(pool, *vectors(spark, d), alpha=0.5)


@query(f"select a.vec_id as a, b.vec_id as b, round({_COS}, 6) as cosine from embeddings q join embeddings v on v.vec_id = q.vec_id + 1, lateral (select q.vec_id) a(vec_id), lateral (select v.vec_id) b(vec_id)")
def cosine_neighbours(spark, d):
    e = read_table(spark, d, "embeddings")
    q, v = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return q.join(v, F.col("b") == F.col("a") + 1).select("a", "b", F.round(cosine_unit(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(r"select query_id, trim(regexp_replace(regexp_replace(query_text, '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as plain from search_params")
def plain_queries(spark, d):
    return searches(spark, d).select("query_id", plain_query("query_text").alias("plain"))


# -- rounds ----------------------------------------------------------------------------------------

_KNOBS = interleave.Knobs(max_chars_per_doc=300, max_total_chars=1700)


def _round_sql(hits: str, prior: str) -> str:
    """One round: ``hits`` names ranked chunks, ``prior`` a table (query_id, doc_id, chars) of what was injected."""
    return f"""known as (select h.*, exists (select 1 from {prior} s where s.query_id = h.query_id and s.doc_id = h.doc_id) as seen from {hits} h),
fresh as (select query_id, doc_id, chunk_idx, row_number() over (partition by query_id order by rank) as rank from (
  select * from known where not seen qualify row_number() over (partition by query_id, doc_id order by rank) = 1)),
used as (select query_id, sum(chars) as used from {prior} group by query_id),
sized as (select f.*, text, length(text) as n, least(length(text), 300) as may, coalesce(used, 0) as used from fresh f join documents using (doc_id) left join used using (query_id) where text is not null),
room as (select *, greatest(0, 1700 - used - coalesce(sum(may) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0)) as room,
  row_number() over (partition by query_id order by rank) as place from sized qualify place <= 4),
placed as (select query_id, doc_id, chunk_idx, rank, least(may, room) as chars, room <= 0 as skipped, room > 0 and n > least(may, room) as truncated, left(text, least(may, room)::int) as text from room)"""


_ROUND_HITS = f"{BM25}, {_pool(16)}, hits as ({_cut(16, 'pool')}), nothing as (select 0 as query_id, 0 as doc_id, 0 as chars where false)"


def _stats_sql(prior: str) -> str:
    return f"""select query_id, candidates, dedup as dedup_skipped_count, 0 as supersede_skipped_count, coalesce(skipped, 0) as budget_skipped_count, coalesce(cut, 0) as truncated_docs,
  coalesce(injected, 0) as injected, coalesce(new, 0) as new_chars, coalesce(used, 0) + coalesce(new, 0) as used_chars_total,
  round(coalesce(new, 0) / greatest(1, coalesce(used, 0) + coalesce(new, 0)), 6) as marginal_gain, round(dedup / greatest(1, candidates), 6) as dedup_ratio
from (select query_id, count(*) as candidates, count(*) filter (seen) as dedup from known group by query_id)
left join (select query_id, count(*) filter (skipped) as skipped, count(*) filter (truncated) as cut, count(*) filter (not skipped) as injected, sum(chars) filter (not skipped) as new from placed group by query_id) using (query_id)
left join used using (query_id)"""


def _round_hits(spark, d):
    return search.search_many(searches(spark, d), *index(spark, d), 16)


def _round_two(spark, d):
    hits = materialise(_round_hits(spark, d))
    docs = documents(spark, d)
    first, stats = interleave.round_many(hits, docs, _KNOBS)
    first = materialise(first)
    return interleave.round_many(hits, docs, _KNOBS, first.select("query_id", "doc_id"), None, first.groupBy("query_id").agg(F.sum("chars").alias("used")))


@query(f"with {_ROUND_HITS}, {_round_sql('hits', 'nothing')} select query_id, doc_id, chunk_idx, rank, text, chars, truncated from placed where not skipped")
def interleave_round1(spark, d):
    return interleave.round_many(_round_hits(spark, d), documents(spark, d), _KNOBS)[0]


@query(f"with {_ROUND_HITS}, {_round_sql('hits', 'nothing')} {_stats_sql('nothing')}")
def interleave_stats1(spark, d):
    return interleave.round_many(_round_hits(spark, d), documents(spark, d), _KNOBS)[1]


_SECOND = f"with {_ROUND_HITS}, first as materialized (with {_round_sql('hits', 'nothing')} select query_id, doc_id, chars from placed where not skipped), {_round_sql('hits', 'first')}"


@query(f"{_SECOND} select query_id, doc_id, chunk_idx, rank, text, chars, truncated from placed where not skipped")
def interleave_round2(spark, d):
    return _round_two(spark, d)[0]


@query(f"{_SECOND} {_stats_sql('first')}")
def interleave_stats2(spark, d):
    return _round_two(spark, d)[1]


@query(f"""with {_ROUND_HITS}, r as (select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from (
  select * from hits qualify row_number() over (partition by query_id, doc_id order by rank) = 1)),
g as (select distinct on (group_key) group_key, doc_ids from candidates where group_key is not null and doc_ids is not null order by group_key, doc_ids),
digests as (select doc_ids[1] as doc_id, list_distinct(doc_ids[2:]) as member_ids from g),
covered as (select distinct r.query_id, m.id as doc_id from r join digests using (doc_id), unnest(member_ids) as m(id))
select query_id, doc_id, rank from r anti join covered using (query_id, doc_id)""")
def supersede(spark, d):
    """The first document of every proposed group plays the digest of the others."""
    groups = read_table(spark, d, "candidates").filter("group_key is not null and doc_ids is not null").groupBy("group_key").agg(F.min("doc_ids").alias("ids"))
    digests = groups.select(F.try_element_at("ids", F.lit(1)).alias("doc_id"), F.expr("array_distinct(slice(ids, 2, greatest(size(ids) - 1, 0)))").alias("member_ids"))
    fresh, _ = interleave.fresh_documents(_round_hits(spark, d), None)
    return interleave.without_superseded(fresh, digests)[0].select("query_id", "doc_id", "rank")


@query(f"""with {BM25}, {_pool(10)}, first as (select distinct query_id, doc_id from pool), {_pool(40, name='wide')},
kept as (select * from wide anti join first using (query_id, doc_id)) {_cut(10, 'kept')}""")
def search_iterative_r2(spark, d):
    """The second page of a search that leaves out the documents of the first."""
    first = materialise(bm25_topk(spark, d).select("query_id", "doc_id").distinct())
    return search.search_many(searches(spark, d), *index(spark, d), 10, exclude=first)


# -- evaluation ------------------------------------------------------------------------------------

_JUDGED = "rel as (select distinct query_id, doc_id from chunk_hits where arm = 'dense' and raw_score > 0.5), nrel as (select query_id, count(*) as n_rel from rel group by query_id)"


def _metrics_sql(ranked: str, cells: str = "", by: str = "", k: int = 10, name: str = "") -> str:
    keys = f"{by}, query_id" if by else "query_id"
    return f"""per{name} as (select {keys}, count(*) as n, coalesce(sum(1 / log2(rank + 1)) filter (rel), 0) as dcg, min(rank) filter (rel) as first, count(*) filter (rel) as found
  from (select r.*, exists (select 1 from rel where rel.query_id = r.query_id and rel.doc_id = r.doc_id) as rel from {ranked} r where rank <= {k}) group by {keys}),
metrics{name} as (select {keys}, round(case when least(n_rel, coalesce(n, 0)) > 0 then coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n_rel, coalesce(n, 0)) + 1), lambda i: 1 / log2(i + 1))) else 0 end, 6) as ndcg,
  round(coalesce(1 / first, 0), 6) as mrr, round(coalesce(found, 0) / n_rel, 6) as recall from nrel {cells} left join per{name} using ({keys}))"""


@query(f"with hits as ({HITS}), {DOCS_OF}, {_JUDGED}, {_metrics_sql('docs_of')} select * from metrics")
def ndcg_mrr_recall(spark, d):
    return evaluation.ranking_metrics(bm25_doc_rank(spark, d), judged(spark, d), 10)


_ALPHAS = [1.0, 0.7, 0.5, 0.3, 0.0]


@query(f"""with {BM25}, {_pool(40)}, cells as (select unnest([1.0, 0.7, 0.5, 0.3, 0.0])::double as alpha),
cos as materialized (select p.*, {_COS} as cosine from pool p {_WITH_COS}),
mixed as (select cos.*, alpha, round(alpha * score + (1 - alpha) * cosine, 9) as mixed from cos, cells),
ranked as (select alpha, query_id, doc_id, row_number() over (partition by alpha, query_id order by mixed desc, rank) as rank from (
  select * from mixed qualify row_number() over (partition by alpha, query_id, doc_id order by mixed desc, rank) = 1)), {_JUDGED},
{_metrics_sql('ranked', 'cross join cells', 'alpha')}
select alpha, count(*) as queries, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall from metrics group by alpha""")
def alpha_sweep(spark, d):
    return evaluation.alpha_sweep(_with_cosine(spark, d), judged(spark, d), _ALPHAS)


def _with_cosine(spark, d):
    pool = search.bm25_top(searches(spark, d), *index(spark, d), 40)
    dv, qv = vectors(spark, d)
    pool = pool.join(dv.withColumnRenamed("embedding", "x"), "doc_id", "left").join(qv.withColumnRenamed("embedding", "y"), "query_id", "left")
    return materialise(pool.withColumn("cosine", cosine_unit(F.col("y"), F.col("x"))).drop("x", "y"))


_CUTS = [3, 10, 20]


@query(f"""with {BM25}, {_pool(40)}, cells as (select unnest([1.0, 0.5, 0.0])::double as alpha),
cos as materialized (select p.*, {_COS} as cosine from pool p {_WITH_COS}),
mixed as (select cos.*, alpha, round(alpha * score + (1 - alpha) * cosine, 9) as mixed from cos, cells),
ranked as (select alpha, query_id, doc_id, row_number() over (partition by alpha, query_id order by mixed desc, rank) as rank from (
  select * from mixed qualify row_number() over (partition by alpha, query_id, doc_id order by mixed desc, rank) = 1)), {_JUDGED},
{', '.join(_metrics_sql('ranked', 'cross join cells', 'alpha', k, f'_{k}') for k in _CUTS)}
{' union all '.join(f"select {k} as topn, alpha, count(*) as queries, round(avg(ndcg), 6) as ndcg, round(avg(mrr), 6) as mrr, round(avg(recall), 6) as recall from metrics_{k} group by alpha" for k in _CUTS)}""")
def retrieval_sweep(spark, d):
    return evaluation.retrieval_sweep(_with_cosine(spark, d), judged(spark, d), [1.0, 0.5, 0.0], _CUTS)


@query("select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events group by event_type")
def latency_percentiles(spark, d):
    return evaluation.nearest_rank(read_table(spark, d, "events"), "value", [50, 95], ["event_type"])


def _item_hits(spark, d):
    items = read_table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return search.search_many(items, *index(spark, d), 10)


_FORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
_ITEM_HITS = f"{_bm25('select item_id as query_id, text as query_text from eval_items')}, {_pool(10)}, hits as ({_cut(10, 'pool')}), {DOCS_OF}"


def _context_sql(texts: str, budget: int) -> str:
    return f"""select query_id, string_agg(left(text, room::int), ' ' order by rank) as context from (
  select *, {budget} - coalesce(sum(length(text) + 1) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) as room from {texts}) where room > 0 group by query_id"""


def _contexts(spark, d, reach: int | None = None):
    hits = materialise(_item_hits(spark, d))
    docs = documents(spark, d).select("doc_id", "text")
    full = search.documents_of(hits).join(docs, "doc_id").select("query_id", "rank", "text")
    parts = hits.join(chunks(spark, d), ["doc_id", "chunk_idx"]).select("query_id", "rank", F.col("chunk_text").alias("text"))
    items = read_table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "answer")
    context = lambda t, name: evaluation.appended_context(t, 4000).withColumnRenamed("context", name)
    out = items.join(context(full, "full"), "query_id", "left").join(context(parts, "snippet"), "query_id", "left")
    return out if reach is None else out.join(evaluation.appended_context(full, reach).withColumnRenamed("context", "oracle"), "query_id", "left")


_CONTEXTS = f"""{_ITEM_HITS}, full_t as (select query_id, rank, text from docs_of join documents using (doc_id)), part_t as (select query_id, rank, chunk_text as text from hits join chunks using (doc_id, chunk_idx)),
f as ({_context_sql('full_t', 4000)}), s as ({_context_sql('part_t', 4000)}),
p as (select coalesce({_FORM.format('answer')} <> '' and contains({_FORM.format('f.context')}, {_FORM.format('answer')}), false) as f, coalesce({_FORM.format('answer')} <> '' and contains({_FORM.format('s.context')}, {_FORM.format('answer')}), false) as s
  from eval_items i left join f on f.query_id = item_id left join s on s.query_id = item_id)"""


@query(f"""with {_CONTEXTS} select count(*) as queries, round(count(*) filter (f) / count(*), 6) as full_rate, round(count(*) filter (s) / count(*), 6) as snippet_rate,
  round(100 * (count(*) filter (f) - count(*) filter (s)) / count(*), 4) as delta_points, count(*) filter (f and s) as both, count(*) filter (not f and not s) as neither from p""")
def injection_ablation(spark, d):
    return evaluation.presence_rates(_contexts(spark, d))


@query(f"""with {_CONTEXTS},
o as ({_context_sql('full_t', 100_000_000)}),
q as (select coalesce({_FORM.format('answer')} <> '' and contains({_FORM.format('f.context')}, {_FORM.format('answer')}), false)::int as f, coalesce({_FORM.format('answer')} <> '' and contains({_FORM.format('s.context')}, {_FORM.format('answer')}), false)::int as s,
  coalesce({_FORM.format('answer')} <> '' and contains({_FORM.format('o.context')}, {_FORM.format('answer')}), false)::int as o from eval_items i left join f on f.query_id = item_id left join s on s.query_id = item_id left join o on o.query_id = item_id),
r as (select count(*) as queries, avg(f) as f, avg(s) as s, avg(o) as o from q)
select queries, round(f, 6) as full_rate, round(s, 6) as snippet_rate, round(o, 6) as oracle_rate, round(100 * (f - s), 4) as delta_points, round(case when o > 0 then f / o else 1 end, 6) as oracle_capture, case when o > 0 then f / o else 1 end >= 0.95 and f > s as passed from r""")
def ablation_gate(spark, d):
    """Full texts under a budget against snippets, and against the same texts whole: what is within reach."""
    return evaluation.ablation_gate(_contexts(spark, d, 100_000_000))


@query(f"""with {_ITEM_HITS}, has as (select query_id, max(contains({_FORM.format('text')}, {_FORM.format('answer')}) and {_FORM.format('answer')} <> '') as has
  from (select h.query_id, d.text, i.answer from docs_of h join documents d using (doc_id) join eval_items i on i.item_id = h.query_id) group by query_id)
select item_id as query_id, case when coalesce({_FORM.format('answer')}, '') = '' then 'no_answer' when {_FORM.format('answer')} in ('yes', 'no') then 'yes_no' when coalesce(has, false) then 'extractive' else 'not_extractive' end as verdict
from eval_items left join has on query_id = item_id""")
def answer_filters(spark, d):
    items = read_table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "answer")
    found = search.documents_of(_item_hits(spark, d)).join(documents(spark, d).select("doc_id", "text"), "doc_id").select("query_id", "text")
    return evaluation.answer_filters(items, found)


def _dated_hits(spark, d):
    docs = documents(spark, d).select("doc_id", F.to_date("created_at").alias("date"), F.try_element_at("metadata", F.lit("day")).alias("session"))
    return bm25_doc_rank(spark, d).join(docs, "doc_id")


@query(f"""with hits as ({HITS}), {DOCS_OF} select query_id, doc_id, round(score * (0.2 + 0.8 * pow(0.5, greatest(0, coalesce(date_diff('day', created_at::timestamp::date, date '2031-12-31'), 0)) / 30.0)), 6) as faded
from docs_of join documents using (doc_id)""")
def recency_rerank(spark, d):
    age = F.coalesce(F.datediff(F.lit("2031-12-31").cast("date"), "date"), F.lit(0))
    return _dated_hits(spark, d).select("query_id", "doc_id", F.round(evaluation.recency("score", age), 6).alias("faded"))


@query(f"""with hits as ({HITS}), {DOCS_OF}, h as (select query_id, doc_id, rank, created_at::timestamp::date as date from docs_of join documents using (doc_id)),
gold as (select query_id, min(created_at::timestamp::date) - 1 as lo, max(created_at::timestamp::date) + 1 as hi from chunk_hits join documents using (doc_id) where arm = 'usage' and created_at is not null group by query_id)
select query_id, doc_id, rank from h left join gold using (query_id) where coalesce(date between lo and hi, lo is null)""")
def oracle_band(spark, d):
    gold = _used(spark, d).join(documents(spark, d).select("doc_id", F.to_date("created_at").alias("date")), "doc_id").filter("date is not null")
    return evaluation.date_band(_dated_hits(spark, d), gold.select("query_id", "date")).select("query_id", "doc_id", "rank")


@query(f"""with hits as ({HITS}), {DOCS_OF}, s as (select query_id, metadata['day'] as session, min(rank) as r from docs_of join documents using (doc_id) where metadata['day'] is not null group by all),
o as (select *, row_number() over (partition by query_id order by r, session) - 1 as pos from s),
gold as (select distinct query_id, metadata['day'] as session from chunk_hits join documents using (doc_id) where arm = 'usage' and metadata['day'] is not null)
select query_id, min(pos) as first_gold_rank, count(*) filter (pos < 5) as covered, count(*) as total from gold left join o using (query_id, session) group by query_id""")
def evidence_coverage(spark, d):
    docs = documents(spark, d).select("doc_id", F.try_element_at("metadata", F.lit("day")).alias("session")).filter("session is not null")
    return evaluation.evidence_coverage(_dated_hits(spark, d).filter("session is not null"), _used(spark, d).join(docs, "doc_id"), 5)


@query(f"""with hits as ({HITS}), {DOCS_OF}, s as (select query_id, metadata['day'] as session, min(rank) as r from docs_of join documents using (doc_id) where metadata['day'] is not null group by all),
o as (select *, row_number() over (partition by query_id order by r, session) - 1 as pos from s),
gold as (select distinct query_id, metadata['day'] as session from chunk_hits join documents using (doc_id) where arm = 'usage' and metadata['day'] is not null),
c as (select query_id, min(pos) as first, count(*) filter (pos < 5) as covered, count(*) as total from gold left join o using (query_id, session) group by query_id)
select coll_name, count(*) as n, round(avg(coalesce(first < 5, false)::int), 6) as hit_rate, round(avg(covered / total), 6) as coverage from c join search_params using (query_id) group by coll_name""")
def evidence_by_category(spark, d):
    named = evidence_coverage(spark, d).join(read_table(spark, d, "search_params").select("query_id", "coll_name"), "query_id")
    return evaluation.evidence_by_category(named, "coll_name")


_DIGESTS = """g as (select distinct on (group_key) group_key, doc_ids from candidates where group_key is not null and doc_ids is not null order by group_key, doc_ids),
digests as (select doc_ids[1] as doc_id, min(list_filter(doc_ids[2:], lambda x, i: list_position(doc_ids[2:], x) = i)) as member_ids from g where len(doc_ids) > 0 and doc_ids[1] is not null group by all)"""


def _digests(spark, d):
    """The first document of every proposed group plays the digest of the others; of several the smallest."""
    groups = read_table(spark, d, "candidates").filter("group_key is not null and doc_ids is not null").groupBy("group_key").agg(F.min("doc_ids").alias("ids"))
    named = groups.select(F.try_element_at("ids", F.lit(1)).alias("doc_id"), F.expr("array_distinct(slice(ids, 2, greatest(size(ids) - 1, 0)))").alias("member_ids"))
    return named.filter("doc_id is not null").groupBy("doc_id").agg(F.min("member_ids").alias("member_ids"))


@query(f"""with hits as ({HITS}), {DOCS_OF}, {_DIGESTS},
m as (select query_id, rank, coalesce(member_ids, [docs_of.doc_id]) as ids from docs_of left join digests using (doc_id)),
e as (select query_id, rank, i, ids[i] as doc_id from m, unnest(range(1, len(ids) + 1)) as u(i)),
x as (select query_id, metadata['day'] as session, row_number() over (partition by query_id order by rank, i) as rank from e join documents using (doc_id) where metadata['day'] is not null),
s as (select query_id, session, min(rank) as r from x group by all), o as (select *, row_number() over (partition by query_id order by r, session) - 1 as pos from s),
gold as (select distinct query_id, metadata['day'] as session from chunk_hits join documents using (doc_id) where arm = 'usage' and metadata['day'] is not null)
select query_id, min(pos) as first_gold_rank, count(*) filter (pos < 5) as covered, count(*) as total from gold left join o using (query_id, session) group by query_id""")
def expanded_coverage(spark, d):
    docs = documents(spark, d).select("doc_id", F.try_element_at("metadata", F.lit("day")).alias("session")).filter("session is not null")
    return evaluation.expanded_coverage(bm25_doc_rank(spark, d), _digests(spark, d), docs, _used(spark, d).join(docs, "doc_id"), 5)


_WIDE_DOCS = f"{BM25}, {_pool(40)}, hits as ({_cut(40, 'pool')}), {DOCS_OF}"


@query(f"""with {_WIDE_DOCS}, {_DIGESTS},
covered as (select distinct query_id, m.id as doc_id from docs_of join digests using (doc_id), unnest(member_ids) as m(id) where rank <= 10)
select query_id, doc_id, row_number() over (partition by query_id order by rank) as rank from (select * from docs_of anti join covered using (query_id, doc_id)) qualify row_number() over (partition by query_id order by rank) <= 10""")
def evidence_picks(spark, d):
    return evaluation.evidence_picks(search.documents_of(search.search_many(searches(spark, d), *index(spark, d), 40)), _digests(spark, d))


_SYNTAX = '+the (queue OR planner) -cache "the queue"^2'


@query(f"""with {INDEX}, n as (select doc_id, chunk_idx, t, len(t) as dl, len(list_filter(t, lambda x: x = 'the')) as a, len(list_filter(t, lambda x: x = 'queue')) as b, len(list_filter(t, lambda x: x = 'planner')) as c,
  len(list_filter(t, lambda x: x = 'cache')) as d, len(list_filter(range(1, len(t)), lambda i: t[i] = 'the' and t[i + 1] = 'queue')) as p from toks),
w as (select max(avgdl) as avgdl, ln(1 + (max(n_chunks) - count(*) filter (a > 0) + 0.5) / (count(*) filter (a > 0) + 0.5)) as wa, ln(1 + (max(n_chunks) - count(*) filter (b > 0) + 0.5) / (count(*) filter (b > 0) + 0.5)) as wb,
  ln(1 + (max(n_chunks) - count(*) filter (c > 0) + 0.5) / (count(*) filter (c > 0) + 0.5)) as wc from n, stats)
select doc_id, chunk_idx, round(wa * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / avgdl)) + wb * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / avgdl)) + wc * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * dl / avgdl))
  + 2 * (wa + wb) * p * 2.2 / (p + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) as raw_score from n, w where a > 0 and d = 0""")
def boolean_search(spark, d):
    """All chunks that match a boolean query with a phrase and a boost."""
    c = chunks(spark, d)
    forward, stats = index(spark, d)
    return query_syntax.boolean_search(spark, _SYNTAX, c, scoring.forward_postings(forward), stats)


_SQUAD = r"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w not in ('a', 'an', 'the')), ' ')"


@query(rf"""with p as (select item_id as id, {_SQUAD.format(r"regexp_extract(text, '(?:\S+ ){0,5}\S+$')")} as p, {_SQUAD.format('answer')} as g from eval_items),
w as (select id, list_filter(string_split(p, ' '), lambda t: t <> '') as pw, list_filter(string_split(g, ' '), lambda t: t <> '') as gw, coalesce(p = g, false) as em from p),
s as (select *, coalesce(list_sum(list_transform(list_distinct(pw), lambda t: least(len(list_filter(pw, lambda x: x = t)), len(list_filter(gw, lambda x: x = t))))), 0) as shared from w)
select id, round(case when len(pw) = 0 or len(gw) = 0 then (len(pw) = len(gw))::int else 2.0 * shared / (len(pw) + len(gw)) end, 6) as f1, em from s""")
def token_f1(spark, d):
    items = read_table(spark, d, "eval_items")
    return evaluation.token_f1(items.select(F.col("item_id").alias("id"), F.regexp_extract("text", r"(?:\S+ ){0,5}\S+$", 0).alias("pred"), F.col("answer").alias("gold")))


@query(f"""with hits as ({HITS}), {DOCS_OF}, {_JUDGED}, {_metrics_sql('docs_of')}
select coll_name, count(*) as n, round(avg(recall), 6) as mean_recall, round(count(*) filter (recall = 0) / count(*), 6) as miss_rate from metrics join search_params using (query_id) group by coll_name""")
def category_means(spark, d):
    named = ndcg_mrr_recall(spark, d).join(read_table(spark, d, "search_params").select("query_id", "coll_name"), "query_id")
    return evaluation.category_means(named, "coll_name", "recall")


@query()
def bootstrap_ci(spark, d):
    """Recall of the blend against that of words alone, with its interval."""
    rel = judged(spark, d)
    pool = materialise(search.bm25_top(searches(spark, d), *index(spark, d), limits.fetch_limit(10, True)))  # both rank it
    dv, qv = vectors(spark, d)
    words = search.cut_and_rank(pool, 10, [F.col("rank")])
    blend = search.cut_and_rank(search.blended(pool, 0.3, dv, qv), 10, [F.col("score").desc(), F.col("rank")])
    a, b = (evaluation.ranking_metrics(search.documents_of(hits), rel, 10).select(F.col("query_id").alias("id"), F.col("recall").alias(name)) for hits, name in ((words, "a"), (blend, "b")))
    return evaluation.paired_bootstrap(a.join(b, "id"))


@query("""select doc_id, lang from documents where text is not null qualify row_number() over (partition by lang order by sha256('17:' || doc_id), doc_id) <= 5""")
def seeded_sample(spark, d):
    return evaluation.seeded_sample(documents(spark, d).select("doc_id", "lang"), "lang", "doc_id", 5)


@query("""select coll_name as session, string_agg('[' || (asked_at::timestamp)::date || '] ' || 'user' || ': ' || query_text, chr(10) order by asked_at, query_id) as rendered
from search_params where query_text is not null and asked_at is not null group by coll_name""")
def render_structured(spark, d):
    q = read_table(spark, d, "search_params").filter("query_text is not null and asked_at is not null")
    turns = q.select(F.col("coll_name").alias("session"), F.struct("asked_at", "query_id").alias("pos"), F.lit("user").alias("role"), F.to_date("asked_at").alias("date"), F.col("query_text").alias("text"))
    return evaluation.render_turns(turns)


_EVIDENCE = f"with hits as ({HITS}), {DOCS_OF}, e as (select query_id, rank, text, created_at::timestamp::date as date, metadata['day'] as session from docs_of join documents using (doc_id) where text is not null)"


def _evidence(spark, d):
    docs = documents(spark, d).select("doc_id", "text", F.to_date("created_at").alias("date"), F.try_element_at("metadata", F.lit("day")).alias("session"))
    return bm25_doc_rank(spark, d).join(docs, "doc_id")


@query(f"{_EVIDENCE}, n as (select *, row_number() over (partition by query_id order by rank) as i from e) select query_id, string_agg('[memory ' || i || '] ' || text, chr(10) || chr(10) order by i) as rendered from n group by query_id")
def render_flat(spark, d):
    return evaluation.render_memories(_evidence(spark, d))


@query(f"{_EVIDENCE}, n as (select *, row_number() over (partition by query_id order by rank) as i from e) select query_id, string_agg('[memory ' || i || ' — ' || coalesce(date::varchar, 'unknown date') || '] ' || text, chr(10) || chr(10) order by i) as rendered from n group by query_id")
def render_dated(spark, d):
    return evaluation.render_memories(_evidence(spark, d), dated=True)


@query(f"""{_EVIDENCE}, g as (select query_id, coalesce(date::varchar, 'unknown') as date, session, min(rank) as first, string_agg('- ' || text, chr(10) order by rank) as body from e group by all)
select query_id, string_agg('[session of ' || date || ']' || chr(10) || body, chr(10) || chr(10) order by date, first) as rendered from g group by query_id""")
def render_sessions(spark, d):
    return evaluation.render_sessions(_evidence(spark, d))


@query(f"""select item_id, coalesce(bool_or({_FORM.format('answer')} <> '' and contains({_FORM.format('text')}, {_FORM.format('answer')})), false) as has_answer from eval_items group by item_id""")
def answer_presence(spark, d):
    return read_table(spark, d, "eval_items").select("item_id", F.coalesce(contains_answer("text", "answer"), F.lit(False)).alias("has_answer"))
