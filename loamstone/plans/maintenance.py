"""Queries of deltas, manifests, memory, grouping and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone import limits
from loamstone.functions import exact
from loamstone.functions import text as texts
from loamstone.functions.exact import fnv_hex, sanitized
from loamstone.operators import consolidate, delta, incremental, memory
from loamstone.operators.components import connected_components
from loamstone.plans.registry import query
from loamstone.plans.retrieval import documents
from loamstone.session import read_table, remove_at_exit, shared_dir
from loamstone.sources import readers

# The last successful state of every file, and the last scanned one.
_STORED = """stored as (select doc_id, source_id, content_hash, index_profile_hash from manifest m join (select run_id from sync_runs where status = 'ok') using (run_id)
  where source_id is not null qualify row_number() over (partition by doc_id order by run_id desc, indexed_at desc, content_hash desc) = 1)"""
_SCANNED = """scan as (select doc_id, arg_max(content_hash, (run_id, mtime)) as content_hash, arg_max(source_id, (run_id, mtime)) as source_id from (
  select run_id, mtime, doc_id, source_id, coalesce(content_hash, sha256(text || chr(10) || metadata_json)) as content_hash from scanned) group by doc_id)"""


def stored(spark, d):
    ok = read_table(spark, d, "sync_runs").filter("status = 'ok'").select("run_id")
    m = read_table(spark, d, "manifest").join(ok, "run_id", "left_semi").filter("source_id is not null")
    last = m.groupBy("doc_id").agg(F.max(F.struct("run_id", "indexed_at", "content_hash", "source_id", "index_profile_hash")).alias("r"))
    return last.select("doc_id", "r.source_id", "r.content_hash", "r.index_profile_hash")


def scan(spark, d):
    own = F.coalesce("content_hash", F.sha2(F.concat("text", F.lit("\n"), "metadata_json"), 256))
    s = read_table(spark, d, "scanned").select("doc_id", "run_id", "mtime", own.alias("content_hash"), "source_id")
    return s.groupBy("doc_id").agg(F.max(F.struct("run_id", "mtime", "content_hash", "source_id")).alias("r")).select("doc_id", "r.content_hash", "r.source_id")


_OPEN = "seen as (select distinct doc_id from scanned semi join (select run_id from sync_runs where status = 'open') using (run_id))"


def open_scan(spark, d):
    """Files that the open runs saw."""
    runs = read_table(spark, d, "sync_runs").filter("status = 'open'").select("run_id")
    return read_table(spark, d, "scanned").join(runs, "run_id", "left_semi").select("doc_id").distinct()


def profile(spark, d) -> str:
    return read_table(spark, d, "index_profiles").filter("is_default").select("index_profile_hash").first()[0]


_PROFILE = "(select index_profile_hash from index_profiles where is_default)"

# -- incremental -----------------------------------------------------------------------------------


@query(r"""with state as (
  select run_id, doc_id, r.index_profile_hash as profile, arg_max(coalesce(content_hash, sha256(text || chr(10) || metadata_json)), mtime) as content_hash
  from scanned join sync_runs r using (run_id) where status = 'open' group by all),
done as (select doc_id, content_hash, m.index_profile_hash from manifest m join sync_runs r using (run_id) where status = 'ok'
  qualify row_number() over (partition by doc_id order by run_id desc, indexed_at desc) = 1)
select run_id, doc_id from state s left join done d using (doc_id)
where not coalesce(s.content_hash = d.content_hash and s.profile = d.index_profile_hash, false)""")
def p6_found(spark, d):
    tables = [read_table(spark, d, t) for t in ("scanned", "manifest", "sync_runs")]
    return incremental.open_run_changes(*tables).select("run_id", "doc_id")


# -- deltas and manifests --------------------------------------------------------------------------

_CLASSIFY = f"""{_STORED}, {_SCANNED}, judged as (select s.doc_id, s.content_hash, case
  when d.doc_id is not null and not coalesce(d.source_id = 'fs-02', false) then 'skipped_scope_mismatch'
  when d.doc_id is not null and coalesce(d.content_hash = s.content_hash and d.index_profile_hash = {_PROFILE}, false) then 'unchanged' else 'indexed' end as status
  from scan s left join stored d using (doc_id))"""


@query(f"with {_CLASSIFY} select * from judged")
def delta_classify(spark, d):
    upserts = scan(spark, d).select("doc_id", "content_hash")
    return delta.classify_upserts(upserts, stored(spark, d), profile(spark, d), True, "fs-02").select("doc_id", "content_hash", "status")


@query(f"""with {_CLASSIFY} select count(*) filter (status = 'indexed') as indexed, count(*) filter (status = 'unchanged') as unchanged, count(*) filter (status = 'deleted') as deleted,
  count(*) filter (status = 'not_found') as not_found, count(*) filter (status = 'skipped_scope_mismatch') as skipped_scope_mismatch from judged""")
def delta_counts(spark, d):
    return delta.outcome_counts(delta_classify(spark, d))


@query(f"""with {_STORED}, {_SCANNED} select s.doc_id, s.content_hash, s.source_id from scan s
union all select doc_id, content_hash, source_id from stored anti join scan using (doc_id)""")
def delta_apply(spark, d):
    return delta.upsert(stored(spark, d).select("doc_id", "content_hash", "source_id"), scan(spark, d))


@query(f"""with {_STORED}, {_SCANNED} select s.doc_id, s.content_hash, s.source_id from scan s
union all select doc_id, content_hash, source_id from stored anti join scan using (doc_id)""")
def p6_target(spark, d):
    """The stored states kept as a partitioned target, brought up to the scanned ones by a second run."""
    path = f"{shared_dir(spark)}/loamstone-target-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    target = incremental.PartitionedTarget(path, "doc_id")
    target.run(stored(spark, d).select("doc_id", "content_hash", "source_id"))
    target.run(delta_apply(spark, d))
    return target.read(spark)


@query(f"with {_STORED}, {_OPEN} select doc_id, content_hash, source_id from stored anti join seen using (doc_id)")
def delete_batch(spark, d):
    return delta.delete(stored(spark, d).select("doc_id", "content_hash", "source_id"), open_scan(spark, d))


@query(f"""with {_STORED}, {_SCANNED} select s.doc_id, case when d.doc_id is null then 'not_found' when not coalesce(d.source_id = 'fs-02', false) then 'skipped_scope_mismatch' else 'deleted' end as status
from scan s left join stored d using (doc_id)""")
def delete_scope(spark, d):
    return delta.classify_deletes(scan(spark, d), stored(spark, d), "fs-02")


@query(f"with {_STORED} select doc_id from stored where source_id is distinct from 'fs-02'")
def forget_source(spark, d):
    s = stored(spark, d)
    return delta.delete(s, s.filter("source_id = 'fs-02'").select("doc_id")).select("doc_id")


@query(f"with {_STORED}, {_OPEN} select doc_id from stored anti join seen using (doc_id)")
def prune_set(spark, d):
    """Files of the manifest that the open runs no longer found."""
    return delta.prune_set(stored(spark, d), open_scan(spark, d))


@query(f"""with {_STORED}, {_SCANNED} select count(*) filter (d.doc_id is null) as new_files, count(*) filter (d.doc_id is not null and not coalesce(s.content_hash = d.content_hash, false)) as changed_files,
  count(*) filter (coalesce(s.content_hash = d.content_hash, false)) as unchanged_files from scan s left join stored d using (doc_id)""")
def sync_dry_run(spark, d):
    return delta.sync_preview(scan(spark, d), stored(spark, d))


_STATE = f"case when content_hash is null or index_profile_hash is null then 'legacy_missing' when index_profile_hash <> {_PROFILE} then 'profile_stale' else 'ok' end"


@query(f"with {_STORED} select doc_id, {_STATE} as hash_state from stored")
def hash_state(spark, d):
    return delta.manifest_entries(stored(spark, d), profile(spark, d)).select("doc_id", "hash_state")


@query(f"with {_STORED} select doc_id, content_hash, index_profile_hash, source_id, {_STATE} as hash_state from stored where source_id = 'fs-02' and doc_id > 'fs-02/m' order by doc_id limit 21")
def manifest_page(spark, d):
    """A page of 20 and the row that tells there is another."""
    scope = delta.in_scope(stored(spark, d), "fs-02", "fs-02/")
    return delta.manifest_page(delta.manifest_entries(scope, profile(spark, d)), 20, "fs-02/m")[0]


@query(f"""with {_STORED}, h as (select left(sha256(doc_id), 8) as part, doc_id, sha256(strlen(doc_id) || ':' || doc_id || coalesce(strlen(content_hash) || ':' || content_hash, '-')) as h from stored),
g as (select part, sha256(string_agg(doc_id || h, '' order by doc_id)) as g, count(*) as n from h group by part),
k as (select left(part, 4) as part, sha256(string_agg(part || g, '' order by part)) as g, sum(n) as n from g group by left(part, 4))
select sha256('manifest:v1:' || string_agg(part || g, '' order by part)) as digest, sum(n)::bigint as total_count from k""")
def manifest_digest(spark, d):
    return delta.manifest_digest(stored(spark, d))


@query(f"with {_STORED} select doc_id from stored where starts_with(doc_id, 'fs-0')")
def doc_prefix(spark, d):
    return delta.in_scope(stored(spark, d), prefix="fs-0").select("doc_id")


@query("""with one as (select min(doc_id) as id from documents) select doc_id, text, n_chars, created_at from documents, one where doc_id = id""")
def fetch_doc(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "n_chars", "created_at")
    first = docs.agg(F.min("doc_id")).first()[0]
    return docs.filter(F.col("doc_id") == first)


@query("select coll_name, count(*) as documents, sum(n_chars)::bigint as chars, max(created_at) as newest from documents group by coll_name")
def collection_stats(spark, d):
    return read_table(spark, d, "documents").groupBy("coll_name").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.max("created_at").alias("newest"))


@query("select doc_id, sha256('content:v1:' || strlen(text) || ':' || text || strlen(metadata_json) || ':' || metadata_json) as content_hash from (select distinct doc_id, text, metadata_json from scanned)")
def content_hash(spark, d):
    s = read_table(spark, d, "scanned").select("doc_id", "text", "metadata_json").distinct()
    return s.select("doc_id", texts.content_hash("text", "metadata_json").alias("content_hash"))


# -- files and judgements --------------------------------------------------------------------------


@query(r"""select distinct doc_id, lower(regexp_extract(split_part(doc_id, '/', -1), '^.+\.([^.]+)$', 1)) as ext, case when contains(doc_id, '/') then split_part(doc_id, '/', 1) else '' end as dir,
  strftime(mtime at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as created_at from scanned""")
def fs_ext_dir(spark, d):
    s = read_table(spark, d, "scanned")
    return s.select("doc_id", texts.file_extension("doc_id").alias("ext"), texts.folder("doc_id").alias("dir"), texts.rfc3339("mtime").alias("created_at")).distinct()


_PASSAGES = "p as (select distinct doc_id * 1000 + chunk_idx as query_id, chunk_text as text from chunks where chunk_text is not null)"


@query(f"""with {_PASSAGES}, c as (select doc_id, text from documents where text is not null), e as (select query_id, p.text, min(c.doc_id) as doc_id from p join c on p.text = c.text group by all),
l as (select query_id, min(c.doc_id) as doc_id from (select * from p anti join e using (query_id, text)) r join c on left(r.text, 80) = left(c.text, 80) group by query_id)
select query_id, doc_id from e union select * from l""")
def qrels_prefix_match(spark, d):
    p = read_table(spark, d, "chunks").filter("chunk_text is not null").select((F.col("doc_id") * 1000 + F.col("chunk_idx")).alias("query_id"), F.col("chunk_text").alias("text")).distinct()
    return readers.qrels_by_text(p, documents(spark, d).select("doc_id", "text"))


@query("""with q as (select query_id from search_params semi join (select query_id from chunk_hits where arm = 'dense' and raw_score > 0.5) using (query_id) order by query_id limit 50),
need as (select distinct doc_id from chunk_hits semi join q using (query_id) where arm = 'dense' and raw_score > 0.5), first as (select doc_id from documents order by doc_id limit 100)
select doc_id from first union select doc_id from documents semi join need using (doc_id)""")
def beir_backfill(spark, d):
    """A feature query: 50 questions, the first 100 documents and whatever those need."""
    qrels = read_table(spark, d, "chunk_hits").filter("arm = 'dense' and raw_score > 0.5").select("query_id", "doc_id").distinct()
    data = readers.BeirSet(documents(spark, d).select("doc_id", "text"), read_table(spark, d, "search_params").select("query_id", F.col("query_text").alias("text")), qrels, None)
    return readers.limited_beir(data, 50, 100).corpus.select("doc_id")


# -- scalar functions ------------------------------------------------------------------------------


@query(r"select doc_id, regexp_replace(text, '[ \t]+', ' ', 'g') as text from documents where text is not null")
def collapse_spaces(spark, d):
    return documents(spark, d).select("doc_id", texts.collapse_spaces("text").alias("text"))


_TRIM = r"regexp_replace(capsule_text, '^\s+|\s+$', '', 'g')"
_LOW = rf"""with c as (select distinct doc_id, {_TRIM} as t from capsules where capsule_text is not null),
m as (select doc_id, length(t) as n, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) as a, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as l from c)"""


@query(f"{_LOW} select doc_id, n < 80 or a < 0.4 * n or (len(l) >= 3 and len(list_distinct(l)) = 1) as low from m")
def low_signal_gate(spark, d):
    c = read_table(spark, d, "capsules").filter("capsule_text is not null").select("doc_id", "capsule_text").distinct()
    return c.select("doc_id", texts.low_signal("capsule_text").alias("low"))


@query(f"""{_LOW} select doc_id, case when not (n < 80 or a < 0.4 * n or (len(l) >= 3 and len(list_distinct(l)) = 1)) then null when n < 80 then 'text too short (' || n || ' chars; minimum 80)'
  when a < 0.4 * n then '{texts.LOW_DENSITY}' else '{texts.REPEATED_LINES}' end as reason from m""")
def low_signal_reason(spark, d):
    c = read_table(spark, d, "capsules").filter("capsule_text is not null").select("doc_id", "capsule_text").distinct()
    return c.select("doc_id", texts.low_signal_reason("capsule_text").alias("reason"))


@query(rf"""with c as (select distinct doc_id, kind, capsule_text, {_TRIM} as t from capsules where capsule_text is not null and kind is not null)
select doc_id, case when t = '' then kind else 'summary: ' || kind || chr(10) || 'detail: ' || left(t, 120) end as text, case when t = '' then 0 else length(left(t, 120)) end as detail_chars, t <> '' and length(t) > 120 as truncated from c""")
def compose_rich(spark, d):
    c = read_table(spark, d, "capsules").filter("capsule_text is not null and kind is not null").select("doc_id", "kind", "capsule_text").distinct()
    text, chars, cut = texts.rich_text("kind", "capsule_text", 120)
    return c.select("doc_id", text.alias("text"), chars.alias("detail_chars"), cut.alias("truncated"))


_BARE = r"regexp_replace(w, '^[^\p{L}\p{N}\-_.+/=]+|[^\p{L}\p{N}\-_.+/=]+$', '', 'g')"


@query(rf"""with w as (select doc_id, {_BARE} as b from (select doc_id, unnest(string_split(text, ' ')) as w from documents where text is not null))
select doc_id, count(*) filter (
  (regexp_matches(lower(b), '{texts.SECRET_PREFIX}') and length(b) >= 12) or regexp_matches(b, '^AKIA[A-Z0-9]{{16}}$') or (regexp_matches(b, '^eyJ[^.]*\..*\.') and length(b) >= 24) or regexp_matches(b, '^[0-9A-Fa-f]{{40,}}$')
  or (regexp_matches(b, '^[A-Za-z0-9+/=_-]{{32,}}$') and regexp_matches(b, '[A-Z]')::int + regexp_matches(b, '[a-z]')::int + regexp_matches(b, '[0-9]')::int >= 2)) as secrets from w group by doc_id""")
def secret_token_scan(spark, d):
    words = documents(spark, d).select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy("doc_id").agg(F.count_if(texts.secret_shaped("w")).alias("secrets"))


@query(r"select doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) as short from documents where text is not null and kind = 'turn'")
def short_turns(spark, d):
    return documents(spark, d).filter("kind = 'turn'").select("doc_id", texts.short_turn("text").alias("short"))


# The same masking for an engine without look-around: boundaries are captured, shapes are judged word by word.
_CORE, _EDGE, _NO_WORD = r"[\p{L}\p{N}\-_.+/=]", r"[^ \n\p{L}\p{N}\-_.+/=]", r"[^ \n\p{L}\p{N}_]"
_KEY = "(?i:" + "|".join(sorted(exact.SENSITIVE_KEYS, key=len, reverse=True)) + ")"
_NAMED = rf"""(^|[ \n])(?:((?:{_NO_WORD}*_*(?:(?i:bearer)|{_KEY})_*{_NO_WORD}*|[^ =\n]*{_KEY}{_NO_WORD}*[=:]) (?:[ =:]* )?)(?:{_EDGE}*{_CORE}){{8}}[^ \n]*|([^ =\n]*{_KEY}[^\p{{L}}\p{{N}}_= \n-]*=)[^ \n]+|([^ :\n]*{_KEY}[^\p{{L}}\p{{N}}_: \n-]*:)[^ \n]+)"""
_SHAPED = rf"""(regexp_matches(lower({_BARE}), '{texts.SECRET_PREFIX}') and length({_BARE}) >= 12 or regexp_matches({_BARE}, '^AKIA[A-Z0-9]{{16}}$') or regexp_matches({_BARE}, '^eyJ[^.]*\..*\.') and length({_BARE}) >= 24 or regexp_matches({_BARE}, '^[0-9A-Fa-f]{{40,}}$')
  or regexp_matches({_BARE}, '^[A-Za-z0-9+/=_-]{{32,}}$') and regexp_matches({_BARE}, '[A-Z]')::int + regexp_matches({_BARE}, '[a-z]')::int + regexp_matches({_BARE}, '[0-9]')::int >= 2)"""
_WS = r"\p{Z}\t\r\f\x0B"


def _clean_sql(source: str) -> str:
    """Tables up to ``clean`` (id, t) for a query that gives (id, text)."""
    return rf"""src as ({source}),
one_space as (select id, regexp_replace(replace(chr(10) || text, chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g') as t from src),
no_keys as (select id, regexp_replace(t, '(\n) ?-----BEGIN[^\n]*KEY[^\n]*(?s:.*?)(?:\n ?-----END[^\n]*|\z)', '\1{exact.REDACTED} key block', 'g') as t from one_space),
lines as (select id, i, x[i] as line, len(x) as last from (select id, string_split(t, chr(10)) as x from no_keys), unnest(range(1, len(x) + 1)) as u(i)),
fences as (select *, regexp_matches(line, '^[{_WS}]*```') as fence, sum(regexp_matches(line, '^[{_WS}]*```')::int) over (partition by id order by i) as n from lines),
placed as (select *, case when n % 2 = 1 and not fence then row_number() over (partition by id, n, fence order by i) else 0 end as pos from fences),
cut as (select id, string_agg(case when pos = {exact.FENCE_LINES + 1} and not (line = '' and i = last) then '{exact.FENCE_TRUNCATED}' else line end, chr(10) order by i) as t from placed where pos <= {exact.FENCE_LINES + 1} group by id),
masked as (select id, regexp_replace(regexp_replace(t, '\n[{_WS}\n]*\n', chr(10) || chr(10), 'g'), '{_NAMED}', '\1\2\3\4{exact.REDACTED}', 'g') as t from cut),
shaped as (select id, array_to_string(list_transform(string_split(t, chr(10)), lambda l: array_to_string(list_transform(string_split(l, ' '), lambda w: case when {_SHAPED} then '{exact.REDACTED}' else w end), ' ')), chr(10)) as t from masked),
clean as (select id, regexp_replace(t, '^[{_WS}\n]+|[{_WS}\n]+$', '', 'g') as t from shaped)"""


@query(f"with {_clean_sql('select doc_id as id, text from documents where text is not null')} select id as doc_id, t as text from clean")
def sanitized_texts(spark, d):
    return documents(spark, d).select("doc_id", sanitized("text").alias("text"))


@query(f"""with whole as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as w from documents where text is not null and kind = 'turn'),
{_clean_sql('select doc_id as id, substr(w, 121) as text from whole')}
select doc_id, case when t = '' then left(w, 120) else 'summary: ' || left(w, 120) || chr(10) || 'detail: ' || left(t, 800) end as rich from whole join clean on id = doc_id""")
def rich_turns(spark, d):
    return documents(spark, d).filter("kind = 'turn'").select("doc_id", texts.rich_turn("text", sanitized).alias("rich"))


@query("select distinct source_id, split_part(source_id, '-', 1) as session from capsules where source_id is not null")
def session_of(spark, d):
    return read_table(spark, d, "capsules").filter("source_id is not null").select("source_id", texts.session_of("source_id", "-").alias("session")).distinct()


@query(r"""select query_id, strlen(query_text) <= 65536 and regexp_matches(query_text, '\S') as valid, greatest(1, least(1000, coalesce(top_k, 16))) as top_k from search_params where query_text is not null""")
def query_checks(spark, d):
    q = read_table(spark, d, "search_params").filter("query_text is not null")
    return q.select("query_id", limits.valid_query(F.col("query_text")).alias("valid"), limits.clamped_top_k(F.col("top_k")).alias("top_k"))


@query("select distinct coll_name, regexp_full_match(coll_name, '[A-Za-z0-9_:-]{1,128}') as valid from documents where coll_name is not null")
def name_checks(spark, d):
    return read_table(spark, d, "documents").filter("coll_name is not null").select("coll_name", limits.valid_name(F.col("coll_name")).alias("valid")).distinct()


@query("select doc_id, case when contains(text, 'status=') then trim(list_extract(string_split(text, 'status='), -1)) end as rest from documents where text is not null")
def after_marker(spark, d):
    return documents(spark, d).select("doc_id", texts.after_marker("text", "status=").alias("rest"))


# -- memory ----------------------------------------------------------------------------------------


@query("""with c as (select distinct doc_id, capsule_text from capsules where capsule_text is not null),
f as (select doc_id, min(doc_id) over (partition by capsule_text) as first from c)
select doc_id, first <> doc_id as deduplicated, case when first <> doc_id then first end as existing from f""")
def remember_dedup(spark, d):
    """Byte-equal capsules: the first id keeps the text."""
    c = read_table(spark, d, "capsules").filter("capsule_text is not null").select("doc_id", "capsule_text").distinct()
    hashed = c.withColumn("raw_hash", texts.content_hash("capsule_text", F.lit("{}")))
    first = hashed.groupBy("raw_hash").agg(F.min("doc_id").alias("first"))
    out = hashed.join(first, "raw_hash")
    dup = F.col("first") != F.col("doc_id")
    return out.select("doc_id", dup.alias("deduplicated"), F.when(dup, F.col("first")).alias("existing"))


@query(f"""with {_clean_sql("select distinct doc_id || '|' || sha256(capsule_text) as id, capsule_text as text from capsules where capsule_text is not null and doc_id is not null")},
r as (select src.id, split_part(src.id, '|', 1) as request_id, t as c, sha256('content:v1:' || strlen(text) || ':' || text || '2:{{}}') as raw_hash, length(t) as n, length(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g')) as a,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as l from src join clean using (id)),
g as (select *, n < 80 or a < 0.4 * n or (len(l) >= 3 and len(list_distinct(l)) = 1) as low from r),
f as (select raw_hash, min(request_id) as first, 'mem-' || left(sha256(raw_hash || ':' || min(request_id)), 32) as new_id from g where not low group by raw_hash)
select request_id, case when not low then new_id end as doc_id, case when not low then 'summary: ' || c || chr(10) || 'detail: ' || left(c, 800) end as capsule_text, g.raw_hash, not low and request_id <> first as deduplicated,
  case when not low and request_id <> first then new_id end as existing_doc_id, false as forced,
  case when not low then null when n < 80 then 'text too short (' || n || ' chars; minimum 80)' when a < 0.4 * n then '{texts.LOW_DENSITY}' else '{texts.REPEATED_LINES}' end as low_signal_reason
from g left join f on f.raw_hash = g.raw_hash""")
def remember_batch(spark, d):
    c = read_table(spark, d, "capsules").filter("capsule_text is not null")
    requests = c.select(F.col("doc_id").alias("request_id"), F.col("capsule_text").alias("text")).distinct()
    nothing = spark.createDataFrame([], "doc_id string, raw_hash string")
    return memory.remember_batch(requests, nothing)


@query()
def remember_ids(spark, d):
    return memory.random_ids(read_table(spark, d, "capsules").select("doc_id").distinct())


# -- grouping --------------------------------------------------------------------------------------

_TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) >= 3)"
_NOTES = "notes as (select doc_id, text, coalesce(metadata['day'], doc_id::varchar) as session, created_at from documents where text is not null and kind <> 'digest')"
_WEIGHTS = f"""{_NOTES}, tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from notes) group by all),
df as (select term, count(*) as df from tf group by term having df between 2 and 64),
weights as (select doc_id, term, tf, df, round(tf * ln((select count(*) from notes) / df), 9) as weight from tf join df using (term))"""
_TOP = f"{_WEIGHTS}, top as (select doc_id, term, row_number() over (partition by doc_id order by weight desc, term) as pos from weights qualify pos <= 8)"
_EDGES = f"{_TOP}, edges as (select a.doc_id as a, b.doc_id as b, count(*) as shared from top a join top b on a.term = b.term and a.doc_id < b.doc_id group by all having shared >= 3)"
_GROUPS = f"""{_EDGES}, links as (select a as u, b as v from edges union select b, a from edges),
reach as (select u as node, u as root from links union select v, root from reach join links on u = node and root < v),
members as (select node as doc_id, min(root) as group_id from reach group by node)"""


def notes(spark, d):
    docs = documents(spark, d).filter("kind <> 'digest'")
    return docs.select("doc_id", "text", F.coalesce(F.try_element_at("metadata", F.lit("day")), F.col("doc_id").cast("string")).alias("session"), "created_at")


def _edges(spark, d):
    return consolidate.similarity_edges(consolidate.top_terms(consolidate.term_weights(notes(spark, d))))


@query(f"with {_TOP} select * from top")
def tfidf_top_terms(spark, d):
    return consolidate.top_terms(consolidate.term_weights(notes(spark, d)))


@query(f"with {_EDGES} select * from edges")
def similarity_edges(spark, d):
    return _edges(spark, d)


@query(f"with recursive {_GROUPS} select doc_id as node, group_id as component from members")
def components(spark, d):
    return connected_components(_edges(spark, d), "a", "b")


_OLD = """old as (select group_key as digest_key, list_distinct(doc_ids) as member_ids from (select distinct on (group_key) group_key, doc_ids from candidates where group_key is not null and doc_ids is not null order by group_key, doc_ids))"""


def _old_digests(spark, d):
    c = read_table(spark, d, "candidates").filter("group_key is not null and doc_ids is not null").groupBy(F.col("group_key").alias("digest_key")).agg(F.array_distinct(F.min("doc_ids")).alias("member_ids"))
    return c.withColumn("member_count", F.size("member_ids").cast("bigint"))


_CANDIDATES = f"""{_GROUPS}, {_OLD},
overlap as (select group_id, digest_key, len(member_ids) as size, count(*) as n from (select digest_key, member_ids, unnest(member_ids) as doc_id from old) o join members using (doc_id) group by all having n * 2 >= size),
kept as (select group_id, digest_key as key from overlap qualify row_number() over (partition by group_id order by n desc, digest_key) = 1),
own as (select group_id, string_agg(term, '+' order by term) as own_key from (select group_id, term, count(*) as n from members join top using (doc_id) group by group_id, term qualify row_number() over (partition by group_id order by n desc, term) <= 4) group by group_id),
grouped as (select group_id, count(*) as members, count(distinct session) as sessions, sum(length(text))::bigint as total_chars, list(doc_id order by created_at nulls first, doc_id) as doc_ids from members join notes using (doc_id) group by group_id having members >= 3 and sessions >= 2),
cand as (select coalesce(k.key, own_key) as key, doc_ids, members, total_chars, old.digest_key is not null as stale from grouped left join kept k using (group_id) join own using (group_id) left join old on old.digest_key = coalesce(k.key, own_key)
  where not coalesce(members <= len(old.member_ids) + 2, false))"""


@query(f"with recursive {_CANDIDATES} select * from cand")
def consolidation_candidates(spark, d):
    return consolidate.select_candidates(notes(spark, d), _old_digests(spark, d), all_groups=True)


@query(f"with recursive {_CANDIDATES} select * from cand order by stale desc, members desc, key limit 3")
def consolidation_next(spark, d):
    return consolidate.select_candidates(notes(spark, d), _old_digests(spark, d))


@query(rf"""with g as (select distinct on (group_key) group_key as key, doc_ids from candidates where group_key is not null and doc_ids is not null order by group_key, doc_ids),
m as (select key, doc_id, min(pos) - 1 as pos from (select key, unnest(doc_ids) as doc_id, unnest(range(1, len(doc_ids) + 1)) as pos from g) group by key, doc_id),
s as (select key, pos, i, regexp_replace(p[i], '^\s+|\s+$', '', 'g') as s from (select key, pos, regexp_split_to_array(text, '[\n.]') as p from m join documents using (doc_id) where text is not null), unnest(range(1, len(p) + 1)) as u(i)),
n as (select key, pos, i, s from s where regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g') <> '' qualify row_number() over (partition by key, lower(regexp_replace(s, '[^\p{{L}}\p{{N}}]', '', 'g')) order by pos, i) = 1),
e as (select *, sum(length(s) + 1) over (partition by key order by pos, i) - 1 as stop from n qualify stop <= 800)
select key, string_agg(s, chr(10) order by pos, i) as text from e group by key""")
def digest_concat(spark, d):
    g = read_table(spark, d, "candidates").filter("group_key is not null and doc_ids is not null").groupBy(F.col("group_key").alias("key")).agg(F.min("doc_ids").alias("doc_ids"))
    m = g.select("key", F.posexplode("doc_ids").alias("pos", "doc_id")).groupBy("key", "doc_id").agg(F.min("pos").alias("pos"))
    return consolidate.concat_sentences(m.join(documents(spark, d).select("doc_id", "text"), "doc_id").select("key", "pos", "text"))


@query("""with k as (select distinct group_key, hex(group_key) as h from candidates where group_key is not null)
select group_key, 'digest::' || lower(lpad(to_hex(list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::uhugeint)),
  lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint), 16, '0')) as doc_id from k""")
def digest_ids(spark, d):
    keys = read_table(spark, d, "candidates").filter("group_key is not null").select("group_key").distinct()
    return keys.select("group_key", F.concat(F.lit(consolidate.DIGEST_PREFIX), fnv_hex("group_key")).alias("doc_id"))


@query("""select run_id, doc_id, content_hash, floor((row_number() over (partition by run_id order by doc_id, content_hash) - 1) / 100)::bigint as batch
from (select distinct run_id, doc_id, coalesce(content_hash, sha256(text || chr(10) || metadata_json)) as content_hash from scanned)""")
def batch_slices(spark, d):
    """Files of a run in batches of a hundred."""
    own = F.coalesce("content_hash", F.sha2(F.concat("text", F.lit("\n"), "metadata_json"), 256))
    s = read_table(spark, d, "scanned").select("run_id", "doc_id", own.alias("content_hash")).distinct()
    w = W.partitionBy("run_id").orderBy("doc_id", "content_hash")
    return s.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 100))


