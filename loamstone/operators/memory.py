"""The memory gate: sanitising, refusing low-signal texts, removing duplicates; in batches."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.errors import InvalidInput
from loamstone.functions.exact import sanitized
from loamstone.functions.text import capsule_id, content_hash, low_signal, low_signal_reason, rich_text

DETAIL_CHARS = 800
MIN_SIGNAL_CHARS = 80
TEXT_VERSION = 2


class MemoryKind(str, Enum):
    """Kinds of memories."""

    FACT = "fact"
    EPISODE = "episode"
    PREFERENCE = "preference"
    TASK = "task"

    @classmethod
    def parse(cls, value: str | None) -> "MemoryKind":
        try:
            return cls((value or "fact").strip().lower())
        except ValueError:
            raise InvalidInput(f"unknown memory kind {value!r}") from None


def remember_batch(texts: DataFrame, stored_hashes: DataFrame, min_chars: int = MIN_SIGNAL_CHARS, detail_chars: int = DETAIL_CHARS) -> DataFrame:
    """Outcomes for a batch of memories.

    ``texts`` has (request_id, text) and may have ``explicit_id`` and ``forced``; ``stored_hashes`` (doc_id,
    raw_hash) of what is kept already. Gives request_id, doc_id, capsule_text, raw_hash, deduplicated,
    existing_doc_id, forced and low_signal_reason. A text is sanitised before anything else is made of it,
    so no secret reaches the capsule. Of equal texts without explicit ids in the batch the one with the
    smallest request is kept; the others, like those stored before, name it.
    """
    t = texts
    if "explicit_id" not in t.columns:
        t = t.withColumn("explicit_id", F.lit(None).cast("string"))
    if "forced" not in t.columns:
        t = t.withColumn("forced", F.lit(False))
    clean = t.withColumn("clean", sanitized("text")).withColumn("raw_hash", content_hash("text", F.lit("{}")))
    reason = low_signal_reason("clean", min_chars)
    gated = clean.withColumn("low", low_signal("clean", min_chars)).withColumn("refused", F.col("low") & ~F.coalesce("forced", F.lit(False)))
    capsule, _, _ = rich_text("clean", "clean", detail_chars)
    gated = gated.withColumn("capsule_text", F.when(~F.col("refused"), capsule)).withColumn("low_signal_reason", F.when(F.col("refused"), reason))
    kept = gated.filter(~F.col("refused") & F.col("explicit_id").isNull()).groupBy("raw_hash").agg(F.min("request_id").alias("first_request"))
    known = stored_hashes.groupBy("raw_hash").agg(F.min("doc_id").alias("stored_id"))
    new_ids = kept.join(known, "raw_hash", "left").withColumn("new_id", F.coalesce("stored_id", F.concat(F.lit("mem-"), F.left(F.sha2(F.concat("raw_hash", F.lit(":"), F.col("first_request").cast("string")), 256), F.lit(32)))))
    out = gated.join(new_ids, "raw_hash", "left")
    free = ~F.col("refused") & F.col("explicit_id").isNull()
    dup = free & (F.col("stored_id").isNotNull() | (F.col("request_id") != F.col("first_request")))
    return out.select(
        "request_id",
        F.when(F.col("refused"), F.lit(None)).otherwise(F.coalesce("explicit_id", "new_id")).alias("doc_id"),
        "capsule_text",
        "raw_hash",
        F.coalesce(dup, F.lit(False)).alias("deduplicated"),
        F.when(dup, F.col("new_id")).alias("existing_doc_id"),
        (F.coalesce("forced", F.lit(False)) & F.col("low")).alias("forced"),
        "low_signal_reason",
    )


def random_ids(rows: DataFrame) -> DataFrame:
    """Rows with a fresh random capsule id each."""
    return rows.withColumn("new_doc_id", capsule_id())
