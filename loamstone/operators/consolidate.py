"""Grouping related documents and distilling them into digests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.exact import fnv1a64, sanitized
from loamstone.functions.text import grouping_terms
from loamstone.operators.components import connected_components
from loamstone.session import materialise

DIGEST_PREFIX = "digest::"


@dataclass(frozen=True)
class Options:
    """Bounds of grouping and distilling."""

    top_terms_per_doc: int = 8
    max_term_df: int = 64
    min_shared_terms: int = 3
    min_members: int = 3
    min_sessions: int = 2
    stale_margin: int = 2
    max_candidates: int = 3
    max_member_chars: int = 12_000
    digest_max_chars: int = 800


def digest_id(key: str) -> str:
    return DIGEST_PREFIX + fnv1a64(key)


def is_digest(doc_id: Column, kind: Column) -> Column:
    return F.startswith(doc_id, F.lit(DIGEST_PREFIX)) | F.coalesce(kind == "digest", F.lit(False))


def term_weights(docs: DataFrame, max_df: int = 64) -> DataFrame:
    """(doc_id, term, tf, df, weight) of terms in 2 to ``max_df`` documents; weight is tf * ln(n / df)."""
    tf = docs.select("doc_id", F.explode(grouping_terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.count()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df").between(2, max_df))
    # Terms over max_df are gone from df, so the join has no hot key.
    return tf.join(df, "term").select("doc_id", "term", "tf", "df", F.round(F.col("tf") * F.log(F.lit(float(n)) / F.col("df")), 9).alias("weight"))


def top_terms(weights: DataFrame, per_doc: int = 8) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy(F.col("weight").desc(), "term")
    return weights.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= per_doc).select("doc_id", "term", "pos")


def similarity_edges(top: DataFrame, min_shared: int = 3) -> DataFrame:
    """(a, b, shared), a < b, for documents with ``min_shared`` top terms in common. A term has at most
    ``max_term_df`` documents, which bounds the pairs it makes."""
    t = top.select("doc_id", "term")
    left, right = t.withColumnRenamed("doc_id", "a"), t.withColumnRenamed("doc_id", "b")
    pairs = left.join(right, "term").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.filter(F.col("shared") >= min_shared)


def group_members(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, doc_id) of the components of two documents or more."""
    return connected_components(edges, "a", "b").select(F.col("component").alias("group_id"), F.col("node").alias("doc_id")).join(docs.select("doc_id"), "doc_id", "left_semi")


def inherited_keys(members: DataFrame, digests: DataFrame) -> DataFrame:
    """(group_id, key) of the digest at least half of whose members are in the group; of several the one
    with the most, then the smallest key. ``digests`` has (digest_key, member_ids)."""
    exploded = digests.filter(F.size("member_ids") > 0).select("digest_key", F.size("member_ids").alias("size"), F.explode("member_ids").alias("doc_id"))
    overlap = members.join(exploded, "doc_id").groupBy("group_id", "digest_key", "size").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") * 2 >= F.col("size"))
    w = W.partitionBy("group_id").orderBy(F.col("overlap").desc(), "digest_key")
    return overlap.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("group_id", F.col("digest_key").alias("key"))


def term_keys(members: DataFrame, top: DataFrame, terms: int = 4) -> DataFrame:
    """(group_id, key): the terms most members share, joined in alphabetical order."""
    count = members.join(top, "doc_id").groupBy("group_id", "term").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("group_id").orderBy(F.col("n").desc(), "term")
    best = count.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= terms)
    return best.groupBy("group_id").agg(F.array_join(F.sort_array(F.collect_set("term")), "+").alias("key"))  # four terms a group


def select_candidates(docs: DataFrame, digests: DataFrame | None = None, options: Options = Options(), all_groups: bool = False) -> DataFrame:
    """(key, doc_ids, members, total_chars, stale) of the groups worth distilling.

    ``docs`` has (doc_id, text, session, created_at) and holds no digests; ``digests`` (digest_key,
    member_ids, member_count). A group needs enough members from enough sessions and no fresh digest; stale
    ones come first, then large ones, then by key. ``doc_ids`` are in order of creation.
    """
    top = materialise(top_terms(term_weights(docs, options.max_term_df), options.top_terms_per_doc))
    members = materialise(group_members(docs, similarity_edges(top, options.min_shared_terms)))
    info = members.join(docs.select("doc_id", "session", "created_at", F.length("text").alias("chars")), "doc_id")
    groups = info.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.count_distinct("session").alias("sessions"),
        F.sum("chars").alias("total_chars"),
    )
    groups = groups.filter((F.col("members") >= options.min_members) & (F.col("sessions") >= options.min_sessions))
    own = term_keys(members, top).withColumnRenamed("key", "own_key")
    named = groups.join(own, "group_id", "left")
    if digests is not None:
        named = named.join(inherited_keys(members, digests), "group_id", "left").withColumn("key", F.coalesce("key", "own_key"))
        known = digests.groupBy(F.col("digest_key").alias("key")).agg(F.max("member_count").alias("recorded"))
        named = named.join(known, "key", "left")
    else:
        named = named.withColumn("key", F.col("own_key")).withColumn("recorded", F.lit(None).cast("bigint"))
    named = named.filter(F.coalesce(F.col("key") != "", F.lit(False)))
    fresh = F.col("recorded").isNotNull() & (F.col("members") <= F.col("recorded") + options.stale_margin)
    out = named.filter(~F.coalesce(fresh, F.lit(False))).select("group_id", "key", "members", "total_chars", F.col("recorded").isNotNull().alias("stale"))
    order = [F.col("stale").desc(), F.col("members").desc(), "key"]
    out = materialise(out if all_groups else out.orderBy(*order).limit(options.max_candidates))
    # Only what is chosen lists its documents; of other groups, however large, there are figures alone.
    chosen = info.join(out.select("group_id"), "group_id", "left_semi").groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
    out = out.join(chosen, "group_id").select("key", "doc_ids", "members", "total_chars", "stale")
    return out if all_groups else out.orderBy(*order)


def member_texts(candidates: DataFrame, docs: DataFrame, most: int = 12_000) -> DataFrame:
    """(key, doc_id, pos, text): sanitised member texts in order, cut to ``most`` characters in all."""
    listed = candidates.select("key", F.posexplode("doc_ids").alias("pos", "doc_id"))
    texts = listed.join(docs.select("doc_id", "text"), "doc_id").withColumn("text", sanitized("text"))
    w = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.lit(most) - F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)))
    cut = texts.withColumn("_left", left).filter("_left > 0")
    return cut.select("key", "doc_id", "pos", F.left("text", F.col("_left").cast("int")).alias("text"))


def concat_sentences(texts: DataFrame, most: int = 800) -> DataFrame:
    """(key, text): each group's sentences in order, the first of equal ones only, a line each, up to the
    first that no longer fits in ``most`` characters.

    ``texts`` has (key, pos, text). Sentences end at line ends and full stops and are equal if their
    letters and digits are, case aside.
    """
    parts = texts.select("key", "pos", F.posexplode(F.split("text", r"[\n.]")).alias("i", "sentence")).withColumn("sentence", F.regexp_replace("sentence", r"^\s+|\s+$", ""))
    parts = parts.withColumn("norm", F.lower(F.regexp_replace("sentence", r"[^\p{L}\p{N}]", ""))).filter("norm <> ''")
    first = parts.groupBy("key", "norm").agg(F.min(F.struct("pos", "i", "sentence")).alias("s")).select("key", "s.*")
    w = W.partitionBy("key").orderBy("pos", "i").rowsBetween(W.unboundedPreceding, 0)
    sized = first.withColumn("end", F.sum(F.length("sentence") + 1).over(w) - 1).filter(F.col("end") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "sentence"))), lambda x: x["sentence"])  # `most` characters at most
    return sized.groupBy("key").agg(F.array_join(lines, "\n").alias("text"))


def distill_with(texts: DataFrame, backend: Callable[[str, list[str], int], str], most: int = 800) -> DataFrame:
    """(key, text) by any function of a key, its member texts and the size wanted. A group's texts are
    bounded by :func:`member_texts`."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        key = pdf["key"].iloc[0]
        return pd.DataFrame({"key": [key], "text": [backend(key, pdf["text"].tolist(), most)]})

    return texts.select("key", "pos", "text").groupBy("key").applyInPandas(one, "key string, text string")
