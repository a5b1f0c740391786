"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.llm import collapsing, distinctive, leakage, mixing, nearduplicates, ranking, sentences, splitting
from loamstone.llm.tokens import TOKEN_PATTERN_SQL, token_count
from loamstone.session import read_table, shared_dir

#: The resemblance at which p4 calls two documents near-duplicates.
P4_SIMILARITY = 0.6
ARMS = ["lexical", "dense", "usage"]
#: Characters of a range in p1_ranges: most of the tables' texts then have several.
P1_RANGE = 512


def _p1(spark: SparkSession, d: str, range_chars: int = splitting.DEFAULT_RANGE, texts: bool = False) -> DataFrame:
    """Pieces of the oversized documents."""
    return splitting.split_by_profile(read_table(spark, d, "documents"), read_table(spark, d, "index_profiles"), range_chars, oversized_only=True, texts=texts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(_p1(spark, d))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d, texts=True).select("doc_id", "token_start", "token_count", "char_start", "char_end", "cut_level", "piece_text")


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    """p1_found by the method for texts of more than one range, which no text of the tables needs."""
    return splitting.oversized(_p1(spark, d, P1_RANGE))


def p1_files(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all texts written one after another into a few files, by byte ranges of 1 MiB."""
    folder = f"{shared_dir(spark)}/loamstone-texts-{uuid.uuid4().hex}"
    read_table(spark, d, "documents").select("text").filter("text is not null").coalesce(4).write.option("lineSep", "\n\n").text(folder)
    files = [r[0] for r in spark.read.format("binaryFile").load(folder).select("path").orderBy("path").collect()]  # 4 names
    pieces = splitting.split_files(spark, [f.replace("file:/", "/", 1) if f.startswith("file:/") else f for f in files], 512, 64, 1 << 20)
    return pieces.select(F.md5("path").alias("file"), "byte_start", "byte_end", "token_start", "token_count", "cut_level")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return collapsing.collapse_layouts(read_table(spark, d, "capsules"), "doc_id", "capsule_text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return collapsing.copies(p2_groups(spark, d))


def p3_ranking(spark: SparkSession, d: str) -> DataFrame:
    """All hits, ordered along the first principal component."""
    fused = ranking.fused_ranking(read_table(spark, d, "chunk_hits"), "query_id", ["doc_id", "chunk_idx"], "arm", "raw_score", ARMS)
    return fused.select("query_id", "doc_id", "chunk_idx", *[F.round(f"f_{a}", 9).alias(f"f_{a}") for a in ARMS], F.round("fused", 4).alias("fused"))


def p3_loadings(spark: SparkSession, d: str) -> DataFrame:
    """The first principal component of the arms' rank-transformed scores."""
    wide = ranking.wide_footing(read_table(spark, d, "chunk_hits"), "query_id", ["doc_id", "chunk_idx"], "arm", "raw_score", ARMS)
    loadings, _ = ranking.first_component(wide, [f"f_{a}" for a in ARMS], [1] * len(ARMS))
    return spark.createDataFrame([(a, round(float(x), 4)) for a, x in zip(ARMS, loadings)], "arm string, loading double")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    weights = ranking.alpha_weights(read_table(spark, d, "search_params"))
    fused = ranking.fused_ranking(read_table(spark, d, "chunk_hits"), "query_id", ["doc_id", "chunk_idx"], "arm", "raw_score", ARMS, weights=weights)
    return ranking.best_item(fused, "query_id", ["doc_id", "chunk_idx"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return nearduplicates.near_duplicate_pairs(read_table(spark, d, "documents"), P4_SIMILARITY)


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return nearduplicates.near_duplicate_groups(read_table(spark, d, "documents"), P4_SIMILARITY)


def p5_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every document; scores to three places, which both engines' sums of logs agree on."""
    return distinctive.distinctive_terms(read_table(spark, d, "documents")).select("doc_id", "term", "tf", "df", "cf", F.round("score", 3).alias("score"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.characteristic(distinctive.distinctive_terms(read_table(spark, d, "documents"), least_tf=3))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).filter("kind = 'exact'").select("item_id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[1]


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))[0]


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """The report's figures that do not depend on the draw, and whether the draw kept its balances: as many
    documents as expected but for one, as many tokens but for two documents."""
    report, largest = p8_report(spark, d), read_table(spark, d, "documents").agg(F.max(token_count(F.col("text")))).first()[0]
    kept = [(F.abs(F.col("reached_docs") - F.col("repeats") * F.col("docs")) <= 1.001).alias("documents_kept"), (F.abs(F.col("reached") - F.col("repeats") * F.col("available")) <= 2 * (largest or 0) + 0.001).alias("tokens_kept")]
    return report.select("mix_id", "source", F.round("wanted", 3).alias("wanted"), "available", "docs", F.round("repeats", 6).alias("repeats"), "out_of_reach", *kept)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).filter("out_of_reach").select("mix_id", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    prose = read_table(spark, d, "documents").filter(F.col("kind").isin("note", "turn", "capsule", "digest"))
    return sentences.split_sentences(prose)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (p1_found, p1_pieces, p1_ranges, p1_files, p2_found, p2_groups, p3_found, p3_ranking, p3_loadings, p4_found, p4_groups, p5_found, p5_scores, p7_found, p7_leaks, p8_found, p8_report, p8_balance, p8_mix, p9_found)
    return {f.__name__: f for f in names}


_TOKENS = f"regexp_extract_all(lower(text), '{TOKEN_PATTERN_SQL}')"


_RUNS_SQL = f"""t as (select doc_id, {_TOKENS} as t from documents where text is not null),
            s as (select distinct doc_id, array_to_string(t[i:i + 4], ' ') as s from t, unnest(range(1, len(t) - 3)) as u(i)),
            n as (select doc_id, count(*) as n from s group by doc_id)"""
# Hits with the rank-transformed scores of the arms, and the first eigenvector of their correlation matrix by
# squaring it again and again.
_RANKED_SQL = """wide as (
              select query_id, doc_id, chunk_idx, max(raw_score) filter (arm = 'lexical') as l,
                max(raw_score) filter (arm = 'dense') as d, max(raw_score) filter (arm = 'usage') as u
              from chunk_hits where query_id is not null group by all),
            filled as (
              select query_id, doc_id, chunk_idx, coalesce(l, min(l) over q, 0) as l, coalesce(d, min(d) over q, 0) as d, coalesce(u, min(u) over q, 0) as u
              from wide window q as (partition by query_id)),
            ranked as (
              select *, (rank() over (partition by query_id order by l) + (count(*) over (partition by query_id, l) - 1) / 2 - 0.5) / count(*) over (partition by query_id) as rl,
                (rank() over (partition by query_id order by d) + (count(*) over (partition by query_id, d) - 1) / 2 - 0.5) / count(*) over (partition by query_id) as rd,
                (rank() over (partition by query_id order by u) + (count(*) over (partition by query_id, u) - 1) / 2 - 0.5) / count(*) over (partition by query_id) as ru
              from filled)"""
_LOADINGS_SQL = """power as (
              select 0 as i, 1.0::double as a, corr(rl, rd) as b, corr(rl, ru) as c, 1.0::double as d, corr(rd, ru) as e, 1.0::double as f from ranked
              union all
              select i + 1, (a * a + b * b + c * c) / t, (a * b + b * d + c * e) / t, (a * c + b * e + c * f) / t, (b * b + d * d + e * e) / t, (b * c + d * e + e * f) / t, (c * c + e * e + f * f) / t
              from (select *, a * a + d * d + f * f + 2 * (b * b + c * c + e * e) as t from power) where i < 24),
            w as (select case when a >= d and a >= f then [a / sqrt(a), b / sqrt(a), c / sqrt(a)] when d >= f then [b / sqrt(d), d / sqrt(d), e / sqrt(d)] else [c / sqrt(f), e / sqrt(f), f / sqrt(f)] end as w from power where i = 24),
            l as (select list_transform(w, lambda x: case when list_sum(w) < 0 then -x else x end) as v from w)"""
# The canonical form of a text in SQL, and the full-width forms of ASCII.
_CANON = r"regexp_replace(replace(lower(nfc_normalize({})), 'ß', 'ss'), '[^\p{{L}}\p{{N}}\p{{M}}]', '', 'g')"
_ASCII = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
_FULL_WIDTH = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_COPIES_SQL = rf"""t as (select distinct doc_id, capsule_text as x from capsules where doc_id is not null and capsule_text is not null),
            w as (select doc_id, x, translate(x, '{_FULL_WIDTH}', '{_ASCII}') as y from t),
            b as (select doc_id, y, regexp_replace(y, '^[\s\{{("”“]+|[\s\}})".;,”“]+$', '', 'g') as body from w),
            s as (select doc_id, y, list_transform(['\n+', '\|', ';', ','], lambda p: list_filter(regexp_split_to_array(body, p), lambda v: {_CANON.format('v')} <> '')) as cuts from b),
            f as (select doc_id, y, list_filter(cuts, lambda c: len(c) > 1 and len(list_filter(c, lambda v: not regexp_matches(v, '^[\s"*•#-]*[\p{{L}}\p{{N}}_-]+( [\p{{L}}\p{{N}}_-]+){{0,3}}"?\s*[:=]'))) = 0)[1] as parts from s),
            k as (select doc_id, case when parts is null then 'prose ' || {_CANON.format('y')} else 'list ' || array_to_string(list_sort(list_distinct(list_transform(parts, lambda v:
              {_CANON.format("regexp_extract(v, '^[^:=]*')")} || '=' || {_CANON.format("regexp_replace(v, '^[^:=]*', '')")}))), ' ') end as k from f),
            g as (select doc_id, k, min(doc_id) over (partition by k) as keep from k)"""
_MIX_SQL = f"""d as (select nullif(lower(trim(source)), '') as source, len(regexp_extract_all(coalesce(text, ''), '{TOKEN_PATTERN_SQL}')) as n from documents),
            s as (select source, sum(n) as n, count(*) as docs from d group by source),
            plan as (select mix_id, m.source, max_repeats, target_share * budget_ratio * (select sum(n) from d) as wanted, coalesce(n, 0)::bigint as available, coalesce(docs, 0) as docs
              from (select mix_id, lower(trim(source)) as source, target_share, max_repeats, budget_ratio from mix_targets) m left join s on s.source = m.source)"""


def oracle_sql() -> dict[str, str]:
    sql = _oracle_sql()
    return sql | {"p1_ranges": sql["p1_found"]}


def _oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""
            with p as (select * from index_profiles), d as (
              select d.doc_id, d.text, coalesce(p.chunk_size, (select min(chunk_size) from p where is_default)) as size
              from documents d left join p using (index_profile_hash) where d.text is not null),
            c as (select doc_id, size, len(regexp_extract_all(text, '{TOKEN_PATTERN_SQL}')) as n,
                list_max(list_transform(regexp_split_to_array(text, '[\\x{{00}}-\\x{{20}}\\x{{A0}}\\x{{3000}}.!?。！？।؟…]'),
                  lambda x: len(regexp_extract_all(x, '{TOKEN_PATTERN_SQL}')))) as m from d)
            select doc_id, 'split' as reason from c where n > size
            union all select doc_id, 'hard' from c where n > size and m > size""",
        "p2_found": rf"""
            with {_COPIES_SQL}
            select min(keep) as keep_id, doc_id as copy_id from g where keep <> doc_id group by doc_id""",
        "p2_groups": rf"""
            with {_COPIES_SQL}
            select keep as keep_id, doc_id as copy_id, count(*) over (partition by k) as copies, starts_with(k, 'list') as is_list from (select distinct * from g)""",
        "p3_found": f"""
            with {_RANKED_SQL},
            scored as (select query_id, doc_id, chunk_idx, round(coalesce(dense_alpha, 1)::double * rl + (1 - coalesce(dense_alpha, 1)::double) / 2 * (rd + ru), 12) as s
              from ranked join search_params using (query_id))
            select query_id, doc_id, chunk_idx from scored
            qualify row_number() over (partition by query_id order by s desc, doc_id, chunk_idx) = 1""",
        "p3_loadings": f"""
            with recursive {_RANKED_SQL}, {_LOADINGS_SQL}
            select unnest(['lexical', 'dense', 'usage']) as arm, round(unnest(v), 4) as loading from l""",
        "p3_ranking": f"""
            with recursive {_RANKED_SQL}, {_LOADINGS_SQL}
            select query_id, doc_id, chunk_idx, round(rl, 9) as f_lexical, round(rd, 9) as f_dense, round(ru, 9) as f_usage, round(v[1] * rl + v[2] * rd + v[3] * ru, 4) as fused from ranked, l""",
        "p4_found": f"""
            with {_RUNS_SQL},
            p as (select a.doc_id as doc_a, b.doc_id as doc_b, count(*) as shared from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all)
            select doc_a, doc_b from p join n a on a.doc_id = doc_a join n b on b.doc_id = doc_b where shared * 100 >= (a.n + b.n - shared) * 60""",
        "p4_groups": f"""
            with recursive {_RUNS_SQL},
            h as (select doc_id, md5(string_agg(s, '|' order by s)) as h from s group by doc_id),
            c as (select doc_id, min(doc_id) over (partition by h) as class_id from h),
            r as (select s.* from s where doc_id in (select class_id from c)),
            p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from r a join r b on a.s = b.s and a.doc_id < b.doc_id group by all),
            l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where shared * 100 >= (x.n + y.n - shared) * 60),
            both_ways as (select a as u, b as v from l union select b, a from l),
            reach as (select u as node, u as root from both_ways union select v, root from reach join both_ways on u = node and root < v),
            g as (select node, min(root) as root from reach group by node),
            k as (select u, count(*) as links from both_ways group by u),
            d as (select distinct doc_id, coalesce(class_id, doc_id) as class_id from documents left join c using (doc_id) where doc_id is not null)
            select doc_id, class_id, coalesce(root, class_id) as group_id, coalesce(links, 0) as links from d left join g on node = class_id left join k on u = class_id""",
        "p5_found": f"""
            with t as (select doc_id, unnest({_TOKENS}) as term from documents where text is not null),
            c as (select doc_id, term, count(*) as tf from t group by all),
            d as (select *, count(*) over (partition by term) as df from c)
            select doc_id, term from d
            where length(term) >= 4 and not regexp_matches(term, '[\\p{{Nd}}_]') and tf >= 3 and df between 2 and 12""",
        "p5_scores": f"""
            with t as (select doc_id, unnest({_TOKENS}) as term from documents where text is not null),
            c as (select doc_id, term, count(*) as tf from t group by all),
            d as (select *, (sum(tf) over (partition by doc_id))::bigint as n, count(*) over (partition by term) as df, (sum(tf) over (partition by term))::bigint as cf, (sum(tf) over ())::bigint as total from c),
            k as (select distinct cf, n, tf, total from d),
            w as (select cf, n, tf, list_transform(range(greatest(tf, n + cf - total), least(cf, n) + 1), lambda x:
                lgamma(cf + 1) - lgamma(x + 1) - lgamma(cf - x + 1) + lgamma(total - cf + 1) - lgamma(n - x + 1) - lgamma(total - cf - n + x + 1)
                - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)) as l from k),
            p as (select cf, n, tf, least(0, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))) as log_p from w),
            r as (select d.*, log_p, log_p + ln(count(*) over (partition by doc_id) / row_number() over (partition by doc_id order by log_p, term)) as q from d join p using (cf, n, tf))
            select doc_id, term, tf, df, cf, round(0 - least(0, min(q) over (partition by doc_id order by log_p desc, term desc rows unbounded preceding)) / ln(10), 3) + 0 as score from r""",
        "p7_found": f"""
            with i as (select item_id, {_TOKENS} as t from eval_items where text is not null),
            r as (select distinct item_id, array_to_string(t[k:k + 12], ' ') as g from i, unnest(range(1, len(t) - 11)) as u(k)),
            d as (select doc_id, {_TOKENS} as t from documents where text is not null),
            w as (select doc_id, array_to_string(t[k:k + 12], ' ') as g from d, unnest(range(1, len(t) - 11)) as u(k))
            select distinct item_id, doc_id from r join w using (g)""",
        "p8_found": f"""
            with {_MIX_SQL} select mix_id, source from plan where max_repeats * available < wanted""",
        "p8_balance": f"""
            with {_MIX_SQL}
            select mix_id, source, round(wanted, 3) as wanted, available, docs, round(case when available > 0 then least(wanted / available, max_repeats) else 0 end, 6) as repeats,
              max_repeats * available < wanted as out_of_reach, true as documents_kept, true as tokens_kept from plan""",
    }
