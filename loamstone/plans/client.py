"""Queries through the calls of a collection: index, search, sync, forget, manifest and rounds on stored files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from loamstone.collection import Collection, Engine
from loamstone.config import Config
from loamstone.operators.interleave import Knobs
from loamstone.plans import retrieval
from loamstone.plans.registry import query
from loamstone.session import read_table, remove_at_exit, shared_dir

# Texts as their plain words, which both engines take for words.
_PLAIN = "plain as (select doc_id::varchar as doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') as text, kind, created_at from documents where text is not null)"


def _on_plain(sql: str) -> str:
    """SQL on the plain words in place of the documents."""
    return re.sub(r"\b(from|join) documents\b", r"\1 plain", sql)


def plain_documents(spark, d):
    words = F.array_join(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), " ")
    docs = retrieval.documents(spark, d)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), words.alias("text"), F.create_map().cast("map<string,string>").alias("metadata"), "created_at", "kind")


def collection(spark, name: str = "docs") -> Collection:
    root = f"{shared_dir(spark)}/loamstone-engine-{uuid.uuid4().hex}"
    remove_at_exit(spark, root)
    return Engine(spark, root, Config(buckets=4)).collection(name)


def _first_question(spark, d) -> str:
    return read_table(spark, d, "search_params").filter(F.regexp_like("query_text", F.lit(_WORDS))).agg(F.min_by("query_text", "query_id")).first()[0]


# The first question with two plain words.
_WORDS = "[A-Za-z]+ [A-Za-z]+"
_QUESTION = f"select query_id, query_text from search_params where query_id = (select min(query_id) from search_params where regexp_matches(query_text, '{_WORDS}'))"
_ONE = f"with {_PLAIN}, {_on_plain(retrieval._bm25(_QUESTION))}"


@query(f"{_ONE}, {retrieval._pool(10)} select doc_id, chunk_idx, raw_score, score, rank from pool")
def collection_search(spark, d):
    """Search of one question in a stored collection."""
    c = collection(spark)
    c.index_table(plain_documents(spark, d))
    hits = c.search(_first_question(spark, d), 10)["hits"]
    rows = [(h["doc_id"], h["chunk_idx"], h["raw_score"], h["score"], i + 1) for i, h in enumerate(hits)]
    return spark.createDataFrame(rows, "doc_id string, chunk_idx bigint, raw_score double, score double, rank int")


_HASH = "sha256('content:v1:' || strlen(text) || ':' || text || '2:{}')"


@query(f"""with {_PLAIN}, kept as (select doc_id, case when kind = 'note' then text || ' revised' else text end as text from plain where kind is distinct from 'log')
select doc_id, text, {_HASH} as content_hash from kept""")
def collection_layers(spark, d):
    """A collection after three commits and a forgotten source: what is in force in its layers."""
    c, docs = collection(spark), plain_documents(spark, d)
    c.index_table(docs)
    c.index_table(docs.filter("kind = 'note'").withColumn("text", F.concat("text", F.lit(" revised"))))
    c.index_table(docs.filter("kind = 'log'"), "logs")
    c.forget(source_id="logs")
    return c.documents().select("doc_id", "text", "content_hash")


@query(f"""with {_PLAIN} select doc_id, {_HASH} as content_hash, 'ok' as hash_state, (select count(*) from plain) as total_count from plain where doc_id > '2' order by doc_id limit 25""")
def collection_manifest(spark, d):
    """A page of a collection's manifest with the count of the whole scope."""
    c = collection(spark)
    c.index_table(plain_documents(spark, d))
    page = c.manifest(limit=25, cursor="2")
    rows = [(e["doc_id"], e["content_hash"], e["hash_state"], page["total_count"]) for e in page["entries"]]
    return spark.createDataFrame(rows, "doc_id string, content_hash string, hash_state string, total_count bigint")


@query(f"""{_ONE}, {retrieval._pool(16)}, hits as ({retrieval._cut(16, 'pool')}), nothing as (select 0 as query_id, '' as doc_id, 0 as chars where false),
{_on_plain(retrieval._round_sql('hits', 'nothing'))} select doc_id, chunk_idx, rank, text, chars, truncated from placed where not skipped""")
def collection_round(spark, d):
    """The first bounded round of one question on a stored collection."""
    c = collection(spark)
    c.index_table(plain_documents(spark, d))
    out = c.interleave_round(_first_question(spark, d), None, Knobs(top_k=16, max_chars_per_doc=300, max_total_chars=1700))
    rows = [tuple(i[k] for k in ("doc_id", "chunk_idx", "rank", "text", "chars", "truncated")) for i in out["injected"]]
    return spark.createDataFrame(rows, "doc_id string, chunk_idx bigint, rank int, text string, chars bigint, truncated boolean")
