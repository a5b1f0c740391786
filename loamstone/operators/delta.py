"""Deltas, manifests and fingerprints as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone import limits
from loamstone.functions.text import hash_state


def last_per_key(rows: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Of rows with the same key the one written last (ties: any)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(stored: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with the same key."""
    return stored.join(new.select(key), key, "left_anti").unionByName(new)


def delete(stored: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    return stored.join(keys.select(key), key, "left_anti")


def classify_upserts(upserts: DataFrame, stored: DataFrame, profile: Column | str, skip_unchanged: bool, source_id: str | None) -> DataFrame:
    """``upserts`` (doc_id, content_hash, ...) with ``status``: skipped_scope_mismatch if a source is given
    and the stored document has another or none, else unchanged if both hashes agree and that is to be
    skipped, else indexed."""
    profile = F.lit(profile) if isinstance(profile, str) else profile
    old = stored.select("doc_id", F.col("content_hash").alias("_h"), F.col("index_profile_hash").alias("_p"), F.col("source_id").alias("_s"), F.lit(True).alias("_there"))
    joined = upserts.join(old, "doc_id", "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    foreign = there & ~F.coalesce(F.col("_s") == F.lit(source_id), F.lit(False)) if source_id is not None else F.lit(False)
    same = there & F.coalesce((F.col("_h") == F.col("content_hash")) & (F.col("_p") == profile), F.lit(False))
    status = F.when(foreign, "skipped_scope_mismatch").when(same & F.lit(skip_unchanged), "unchanged").otherwise("indexed")
    return joined.withColumn("status", status).drop("_h", "_p", "_s", "_there")


def classify_deletes(deletes: DataFrame, stored: DataFrame, source_id: str | None) -> DataFrame:
    """(doc_id, status): not_found, skipped_scope_mismatch or deleted."""
    old = stored.select("doc_id", F.col("source_id").alias("_s"), F.lit(True).alias("_there"))
    joined = deletes.select("doc_id").distinct().join(old, "doc_id", "left")
    foreign = ~F.coalesce(F.col("_s") == F.lit(source_id), F.lit(False)) if source_id is not None else F.lit(False)
    return joined.select("doc_id", F.when(F.col("_there").isNull(), "not_found").when(foreign, "skipped_scope_mismatch").otherwise("deleted").alias("status"))


def outcome_counts(results: DataFrame) -> DataFrame:
    """One row with the number of results of each status."""
    count = lambda s: F.count_if(F.col("status") == s)
    return results.agg(count("indexed").alias("indexed"), count("unchanged").alias("unchanged"), count("deleted").alias("deleted"), count("not_found").alias("not_found"), count("skipped_scope_mismatch").alias("skipped_scope_mismatch"))


def in_scope(stored: DataFrame, source_id: str | None = None, prefix: str | None = None) -> DataFrame:
    """Documents of one source (none is no source) whose id begins with ``prefix``."""
    if source_id is not None:
        stored = stored.filter(F.col("source_id") == source_id)
    if prefix:
        stored = stored.filter(F.startswith(F.col("doc_id"), F.lit(prefix)))
    return stored


def manifest_entries(stored: DataFrame, profile: str) -> DataFrame:
    state = hash_state("content_hash", "index_profile_hash", F.lit(profile))
    return stored.select("doc_id", "content_hash", "index_profile_hash", "source_id", state.alias("hash_state"))


def manifest_digest(entries: DataFrame) -> DataFrame:
    """One row (digest, total_count) over the ids and hashes of all entries, in any order.

    Entries are hashed together by the first eight digits of their id's hash, in id order, these groups by
    the first four, and the rest at last: no group holds more than about 65,536 hashes of a level below,
    for as many entries as there may be.
    """
    item = F.concat(F.octet_length("doc_id").cast("string"), F.lit(":"), F.col("doc_id"), F.coalesce(F.concat(F.octet_length("content_hash").cast("string"), F.lit(":"), F.col("content_hash")), F.lit("-")))
    hashed = entries.select(F.left(F.sha2("doc_id", 256), F.lit(8)).alias("_at"), F.col("doc_id").alias("_by"), F.sha2(item, 256).alias("_h"), F.lit(1).alias("_n"))
    together = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_by", "_h"))), lambda x: F.concat(x["_by"], x["_h"])), ""), 256)
    level = lambda df: df.groupBy("_at").agg(together.alias("_h"), F.sum("_n").alias("_n"))
    for digits in (4, 0):
        hashed = level(hashed).select(F.left("_at", F.lit(digits)).alias("_at"), F.col("_at").alias("_by"), "_h", "_n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_by", "_h"))), lambda x: F.concat(x["_by"], x["_h"])), "")
    return hashed.agg(F.sha2(F.concat(F.lit("manifest:v1:"), joined), 256).alias("digest"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_count"))


def manifest_page(entries: DataFrame, limit: int | None = None, cursor: str | None = None) -> tuple[DataFrame, int]:
    """(entries after ``cursor`` in id order, one more than the limit; the limit). The extra entry only
    tells whether there is a next page."""
    n = limits.manifest_limit(limit)
    rest = entries if cursor is None else entries.filter(F.col("doc_id") > cursor)
    return rest.orderBy("doc_id").limit(n + 1), n


def prune_set(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Documents of the manifest that a scan no longer finds."""
    return manifest.select("doc_id").distinct().join(scanned.select("doc_id"), "doc_id", "left_anti")


def sync_preview(scanned: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: files that are new, changed and unchanged against the manifest (one row a document in each)."""
    old = manifest.select("doc_id", F.col("content_hash").alias("_h"), F.lit(True).alias("_there"))
    joined = scanned.join(old, "doc_id", "left")
    new = F.col("_there").isNull()
    same = F.coalesce(F.col("_h") == F.col("content_hash"), F.lit(False))
    return joined.agg(F.count_if(new).alias("new_files"), F.count_if(~new & ~same).alias("changed_files"), F.count_if(~new & same).alias("unchanged_files"))
