"""Bounded multi-round retrieval: candidates, deduplication, digests, character budgets."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone import limits
from loamstone.errors import InvalidInput
from loamstone.operators.search import documents_of

# Ceilings and defaults of a round.
STATE_VERSION = 1
MAX_ROUNDS, MAX_DOC_CHARS, MAX_TOTAL_CHARS, MAX_FETCH, MAX_STATE_IDS = 32, 64 * 1024, 1024 * 1024, 64, 100_000


@dataclass(frozen=True)
class Knobs:
    top_k: int = 16
    fetch_top_n: int = 4
    max_chars_per_doc: int = 2000
    max_total_chars: int = 16_000
    max_rounds: int = 5
    low_gain_threshold: float = 0.05

    def clamped(self) -> "Knobs":
        k = limits.top_k(self.top_k)
        within = lambda v, most: max(1, min(most, v))
        return Knobs(k, min(within(self.fetch_top_n, MAX_FETCH), k), within(self.max_chars_per_doc, MAX_DOC_CHARS), within(self.max_total_chars, MAX_TOTAL_CHARS), within(self.max_rounds, MAX_ROUNDS), limits.low_gain(self.low_gain_threshold))


@dataclass
class RoundState:
    """What a client carries from round to round."""

    schema_version: int = STATE_VERSION
    round: int = 0
    seen_doc_ids: list[str] = field(default_factory=list)
    injected_units: list[str] = field(default_factory=list)
    used_chars_total: int = 0
    empty_rounds: int = 0
    low_gain_rounds: int = 0

    @classmethod
    def resolve(cls, data: dict | None) -> "RoundState":
        """A state from client data: none is a new one; unknown fields, versions and sizes are refused."""
        if data is None:
            return cls()
        unknown = set(data) - set(cls.__dataclass_fields__)
        if unknown:
            raise InvalidInput(f"unknown state fields {sorted(unknown)}")
        state = cls(**data)
        if state.schema_version != STATE_VERSION:
            raise InvalidInput(f"state version {state.schema_version} is not {STATE_VERSION}")
        if min(state.round, state.used_chars_total, state.empty_rounds, state.low_gain_rounds) < 0:
            raise InvalidInput("state counters are negative")
        if max(len(state.seen_doc_ids), len(state.injected_units)) > MAX_STATE_IDS:
            raise InvalidInput(f"state has over {MAX_STATE_IDS} ids")
        return state.canonical()

    def canonical(self) -> "RoundState":
        return replace(self, seen_doc_ids=sorted(set(self.seen_doc_ids)), injected_units=sorted(set(self.injected_units)))

    def to_dict(self) -> dict:
        return asdict(self)


def budgeted(ranked: DataFrame, cap: int, total: int, fetch: int, used: str = "used") -> DataFrame:
    """Documents in rank order with the characters each may add: the least of its length, ``cap`` and what
    earlier ones left of ``total``.

    ``ranked`` has (query_id, doc_id, rank, text) and ``used``, the characters spent before. Of the first
    ``fetch`` documents those without room are ``budget_skipped``; the text is cut to its characters. A
    running sum suffices, since a document either took all it might or spent the rest.
    """
    by_rank = W.partitionBy("query_id").orderBy("rank", "doc_id")
    n = F.length("text")
    may = F.least(n, F.lit(cap))
    before = F.coalesce(F.sum(may).over(by_rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(0), F.lit(total) - F.col(used) - before)
    first = ranked.withColumn("_n", F.row_number().over(by_rank)).withColumn("_room", room).filter(F.col("_n") <= fetch)
    chars = F.least(may, F.col("_room"))
    out = first.withColumn("chars", chars.cast("bigint")).withColumn("budget_skipped", F.col("_room") <= 0)
    out = out.withColumn("truncated", ~F.col("budget_skipped") & (n > F.col("chars")))
    return out.withColumn("text", F.left("text", F.col("chars").cast("int"))).drop("_n", "_room")


def fresh_documents(hits: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(documents not seen yet, by their best chunk and ranked anew; chunks skipped as seen, by query)."""
    if seen is None:
        return documents_of(hits), hits.groupBy("query_id").agg(F.lit(0).cast("bigint").alias("dedup_skipped_count"))
    keys = [c for c in ("query_id", "doc_id") if c in seen.columns]
    mark = seen.select(*keys).distinct().withColumn("_seen", F.lit(True))
    known = hits.join(mark, keys, "left")
    skipped = known.groupBy("query_id").agg(F.count_if(F.col("_seen").isNotNull()).alias("dedup_skipped_count"))
    return documents_of(known.filter(F.col("_seen").isNull())), skipped


def without_superseded(fresh: DataFrame, digests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fresh documents without members of digests that are fresh too; members left out, by query).

    ``digests`` has (doc_id, member_ids array)."""
    covered = fresh.select("query_id", "doc_id").join(digests, "doc_id").select("query_id", F.explode("member_ids").alias("doc_id")).distinct()
    gone = fresh.join(covered, ["query_id", "doc_id"], "left_semi")
    kept = fresh.join(covered, ["query_id", "doc_id"], "left_anti")
    return kept, gone.groupBy("query_id").agg(F.count(F.lit(1)).alias("supersede_skipped_count"))


def round_many(hits: DataFrame, docs: DataFrame, knobs: Knobs, seen: DataFrame | None = None, digests: DataFrame | None = None, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One round for every query of ``hits`` (as :func:`search_many` gives them).

    Returns the injected documents (query_id, doc_id, chunk_idx, rank, text, chars, truncated) and one row
    of statistics a query. ``docs`` has (doc_id, text); ``seen`` the documents of earlier rounds, ``used``
    (query_id, used) the characters they took.
    """
    knobs = knobs.clamped()
    fresh, skipped = fresh_documents(hits, seen)
    if digests is None:
        kept, gone = fresh, None
    else:
        kept, gone = without_superseded(fresh, digests)
    texts = kept.join(docs.select("doc_id", "text"), "doc_id").filter("text is not null")
    spent = texts.withColumn("used", F.lit(0)) if used is None else texts.join(used.select("query_id", "used"), "query_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    placed = budgeted(spent, knobs.max_chars_per_doc, knobs.max_total_chars, knobs.fetch_top_n)
    injected = placed.filter("not budget_skipped").select("query_id", "doc_id", "chunk_idx", "rank", "text", "chars", "truncated")
    per = placed.groupBy("query_id").agg(F.sum(F.when(~F.col("budget_skipped"), F.col("chars"))).alias("new_chars"), F.count_if("budget_skipped").alias("budget_skipped_count"), F.count_if("truncated").alias("truncated_docs"), F.count_if(~F.col("budget_skipped")).alias("injected"))
    stats = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates")).join(skipped, "query_id", "left").join(per, "query_id", "left")
    stats = stats.withColumn("supersede_skipped_count", F.lit(0).cast("bigint")) if gone is None else stats.join(gone, "query_id", "left")
    if used is None:
        stats = stats.withColumn("used", F.lit(0))
    else:
        stats = stats.join(used.select("query_id", "used"), "query_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    stats = stats.select("query_id", *[zero(c) for c in ("candidates", "dedup_skipped_count", "supersede_skipped_count", "budget_skipped_count", "truncated_docs", "injected", "new_chars", "used")])
    total = F.col("used") + F.col("new_chars")
    stats = stats.withColumn("used_chars_total", total).drop("used")
    stats = stats.withColumn("marginal_gain", F.round(F.col("new_chars") / F.greatest(F.lit(1), F.col("used_chars_total")), 6)).withColumn("dedup_ratio", F.round(F.col("dedup_skipped_count") / F.greatest(F.lit(1), F.col("candidates")), 6))
    return injected, stats


def stop_reason(state: RoundState, knobs: Knobs, already: bool = False) -> str | None:
    hit = [name for name, is_hit in (("max_rounds", state.round >= knobs.max_rounds), ("max_total_chars", state.used_chars_total >= knobs.max_total_chars)) if is_hit]
    return f"{' and '.join(hit)} {'already ' if already else ''}reached" if hit else None


def next_state(state: RoundState, knobs: Knobs, injected_ids: list[str], new_chars: int, marginal_gain: float) -> tuple[RoundState, dict]:
    """The state after a round and its stop hints."""
    after = RoundState(
        STATE_VERSION, state.round + 1, [*state.seen_doc_ids, *injected_ids], [*state.injected_units, *injected_ids], state.used_chars_total + new_chars,
        state.empty_rounds + 1 if new_chars == 0 else 0, state.low_gain_rounds + 1 if marginal_gain < knobs.low_gain_threshold else 0,
    ).canonical()
    reason = stop_reason(after, knobs)
    return after, {"hard_stop": reason is not None, "exhausted": new_chars == 0, "exhausted_2_rounds": after.empty_rounds >= 2, "low_gain_2_rounds": after.low_gain_rounds >= 2, "reason": reason}
