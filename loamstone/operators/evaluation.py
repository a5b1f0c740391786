"""Retrieval metrics, ablations and their statistics, for whole sets of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.functions.columns import col
from loamstone.functions.text import answer_form, contains_answer, squad_form
from loamstone.session import materialise

PLACES = 6


def ranking_metrics(ranked: DataFrame, qrels: DataFrame, k: int, by: list[str] | None = None, clip: bool = True, cells: list | None = None) -> DataFrame:
    """(by..., query_id, ndcg, mrr, recall) of every query that has a relevant document.

    ``ranked`` has (by..., query_id, doc_id, rank) with ranks from 1, ``qrels`` (query_id, doc_id).
    Relevance is yes or no. ``cells`` are the values of the one column ``by`` that every query is measured under. With ``clip`` the ideal list is no longer than the one returned.
    """
    by = by or []
    rel = qrels.select("query_id", "doc_id").distinct()
    n_rel = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    top = ranked.filter(F.col("rank") <= k).join(rel.withColumn("_rel", F.lit(1)), ["query_id", "doc_id"], "left")
    per = top.groupBy(*by, "query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("_rel") == 1, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("first"),
        F.count_if(F.col("_rel") == 1).alias("found"),
    )
    expected = n_rel.withColumn(by[0], F.explode(F.array(*map(F.lit, cells)))) if cells is not None else n_rel
    joined = expected.join(per, [*by, "query_id"], "left")
    size = F.least(F.col("n_rel"), F.coalesce("n", F.lit(0)) if clip else F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), size.cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ndcg = F.when(size > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    return joined.select(*by, "query_id", F.round(ndcg, PLACES).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), PLACES).alias("mrr"), F.round(F.coalesce("found", F.lit(0)) / F.col("n_rel"), PLACES).alias("recall"))


def alpha_sweep(pool: DataFrame, qrels: DataFrame, alphas: list[float], k: int = 10) -> DataFrame:
    """(alpha, queries, ndcg, mrr, recall): mean metrics of documents for every weight of the lexical score.

    ``pool`` has (query_id, doc_id, chunk_idx, rank, score, cosine): candidates are drawn and compared once,
    and only their order is made anew for each weight."""
    grid = pool.select("*", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
    mixed = grid.withColumn("mixed", F.round(F.col("alpha") * F.col("score") + (1 - F.col("alpha")) * F.col("cosine"), 9))
    cell = W.partitionBy("alpha", "query_id")
    first = W.partitionBy("alpha", "query_id", "doc_id").orderBy(F.col("mixed").desc(), "rank")
    docs = mixed.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    ranked = docs.withColumn("rank", F.row_number().over(cell.orderBy(F.col("mixed").desc(), "rank"))).select("alpha", "query_id", "doc_id", "rank")
    metrics = ranking_metrics(ranked, qrels, k, ["alpha"], cells=alphas)
    return mean_metrics(metrics, ["alpha"])


def retrieval_sweep(pool: DataFrame, qrels: DataFrame, alphas: list[float], cuts: list[int]) -> DataFrame:
    """(topn, alpha, queries, ndcg, mrr, recall): :func:`alpha_sweep` at every length of list in ``cuts``."""
    cells = [alpha_sweep(pool, qrels, alphas, k).withColumn("topn", F.lit(k)) for k in cuts]
    return reduce(DataFrame.unionByName, cells)


def mean_metrics(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), PLACES).alias(c) for c in ("ndcg", "mrr", "recall")])


def nearest_rank(values: DataFrame, value: str, percents: list[int], by: list[str] | None = None) -> DataFrame:
    """Percentiles by nearest rank, a column p50 and so on each."""
    return values.groupBy(*(by or [])).agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {value})").alias(f"p{p}") for p in percents])


def evidence_coverage(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, first_gold_rank, covered, total): sessions in the order they first appear among the hits
    (query_id, session, rank), held against gold sessions (query_id, session); ranks count from 0."""
    order = hits.groupBy("query_id", "session").agg(F.min("rank").alias("_r"))
    order = order.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("_r", "session")) - 1)
    found = gold.select("query_id", "session").distinct().join(order, ["query_id", "session"], "left")
    return found.groupBy("query_id").agg(F.min("pos").alias("first_gold_rank"), F.count_if(F.col("pos") < k).alias("covered"), F.count(F.lit(1)).alias("total"))


def expand_digests(hits: DataFrame, digests: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, pos): a digest among the hits gives its members in its place."""
    known = hits.join(digests.select("doc_id", "member_ids"), "doc_id", "left")
    members = F.coalesce("member_ids", F.array("doc_id"))
    return known.select("query_id", "rank", F.posexplode(members).alias("pos", "doc_id")).select("query_id", "doc_id", "rank", "pos")


def expanded_coverage(hits: DataFrame, digests: DataFrame, sessions: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """:func:`evidence_coverage` where a digest among the hits (query_id, doc_id, rank) covers the sessions of
    its members, in their order. ``sessions`` has (doc_id, session)."""
    order = W.partitionBy("query_id").orderBy("rank", "pos")
    spread = expand_digests(hits, digests).join(sessions, "doc_id").withColumn("rank", F.row_number().over(order)).select("query_id", "session", "rank")
    return evidence_coverage(spread, gold, k)


def evidence_picks(hits: DataFrame, digests: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, rank): the ``k`` best documents, members of digests among the first ``k`` left out
    and later documents moved up. ``hits`` has one row a document."""
    first = hits.filter(F.col("rank") <= k).join(digests.select("doc_id", "member_ids"), "doc_id")
    covered = first.select("query_id", F.explode("member_ids").alias("doc_id")).distinct()
    left = hits.join(covered, ["query_id", "doc_id"], "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def recency(score: Column | str, age_days: Column | str, half_life: float = 30.0, floor: float = 0.2) -> Column:
    """A score that fades with age to ``floor`` of itself; a negative age counts as none."""
    return col(score) * (floor + (1 - floor) * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), col(age_days).cast("double")) / half_life))


def date_band(hits: DataFrame, gold_dates: DataFrame, slack_days: int = 1) -> DataFrame:
    """Hits (query_id, date, ...) within a day of their query's gold dates (query_id, date); a query
    without any keeps all its hits."""
    band = gold_dates.groupBy("query_id").agg(F.date_sub(F.min("date"), slack_days).alias("_lo"), F.date_add(F.max("date"), slack_days).alias("_hi"))
    joined = hits.join(band, "query_id", "left")
    return joined.filter(F.coalesce(F.col("date").between(F.col("_lo"), F.col("_hi")), F.col("_lo").isNull())).drop("_lo", "_hi")


def appended_context(texts: DataFrame, budget: int) -> DataFrame:
    """(query_id, context): texts in rank order, each after a space, cut to what is left of ``budget``
    characters; the space counts."""
    w = W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0))
    placed = texts.withColumn("_left", F.lit(budget) - used).filter("_left > 0")
    part = F.left("text", F.col("_left").cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"])  # `budget` characters a query
    return placed.groupBy("query_id").agg(F.array_join(parts, " ").alias("context"))


def answer_filters(queries: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, verdict) of (query_id, answer): no_answer, yes_no, extractive if a relevant text (query_id,
    text) has the answer, else not_extractive."""
    form = answer_form("answer")
    has = relevant.join(queries.select("query_id", "answer"), "query_id").groupBy("query_id").agg(F.max(contains_answer("text", "answer")).alias("_has"))
    verdict = F.when(F.coalesce(form == "", F.lit(True)), "no_answer").when(form.isin("yes", "no"), "yes_no").when(F.coalesce("_has", F.lit(False)), "extractive").otherwise("not_extractive")
    return queries.join(has, "query_id", "left").select("query_id", verdict.alias("verdict"))


def presence_rates(contexts: DataFrame) -> DataFrame:
    """One row of answer presence in two contexts (full, snippet) of (answer, full, snippet): rates, their
    difference in points and how often both or neither have it."""
    f, s = contains_answer("full", "answer"), contains_answer("snippet", "answer")
    rows = contexts.select(F.coalesce(f, F.lit(False)).alias("f"), F.coalesce(s, F.lit(False)).alias("s"))
    rate = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), PLACES)
    return rows.agg(F.count(F.lit(1)).alias("queries"), rate(F.col("f")).alias("full_rate"), rate(F.col("s")).alias("snippet_rate"), F.round(100 * (F.count_if("f") - F.count_if("s")) / F.count(F.lit(1)), 4).alias("delta_points"), F.count_if(F.col("f") & F.col("s")).alias("both"), F.count_if(~F.col("f") & ~F.col("s")).alias("neither"))


#: Share of the answers within reach that full texts must bring for the gate to pass.
LEAST_CAPTURE = 0.95


def ablation_gate(contexts: DataFrame, least_capture: float = LEAST_CAPTURE) -> DataFrame:
    """One row of answer presence in three contexts (full, snippet, oracle) of (answer, ...): rates, difference
    in points, the share of the oracle's answers that full texts bring (1 if it has none), and whether that
    is enough and more than snippets bring."""
    present = [F.coalesce(contains_answer(c, "answer"), F.lit(False)).alias(c) for c in ("full", "snippet", "oracle")]
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    rows = contexts.select(*present).agg(F.count(F.lit(1)).alias("queries"), *[(F.count_if(c) / n).alias(c) for c in ("full", "snippet", "oracle")])
    capture = F.when(F.col("oracle") > 0, F.col("full") / F.col("oracle")).otherwise(1.0)
    return rows.select("queries", *[F.round(c, PLACES).alias(f"{c}_rate") for c in ("full", "snippet", "oracle")], F.round(100 * (F.col("full") - F.col("snippet")), 4).alias("delta_points"), F.round(capture, PLACES).alias("oracle_capture"), ((capture >= least_capture) & (F.col("full") > F.col("snippet"))).alias("passed"))


def token_f1(pairs: DataFrame) -> DataFrame:
    """(id, f1, em) of (id, pred, gold): overlap of the normalised words as multisets, and equality."""
    words = lambda c: F.filter(F.split(squad_form(c), " "), lambda t: t != "")
    base = pairs.select("id", words("pred").alias("p"), words("gold").alias("g"), (squad_form("pred") == squad_form("gold")).alias("em"))
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    shared = F.aggregate(F.array_distinct("p"), F.lit(0), lambda s, t: s + F.least(count(F.col("p"), t), count(F.col("g"), t)))
    f1 = F.when((F.size("p") == 0) | (F.size("g") == 0), (F.size("p") == F.size("g")).cast("double")).otherwise(2.0 * shared / (F.size("p") + F.size("g")))
    return base.select("id", F.round(f1, PLACES).alias("f1"), F.coalesce(F.col("em"), F.lit(False)).alias("em"))


def category_means(rows: DataFrame, category: str, value: str) -> DataFrame:
    return rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), PLACES).alias(f"mean_{value}"), F.round(F.count_if(F.col(value) == 0) / F.count(F.lit(1)), PLACES).alias("miss_rate"))


def evidence_by_category(coverage: DataFrame, category: str, k: int = 5) -> DataFrame:
    """(category, n, hit_rate, coverage) of :func:`evidence_coverage` rows: how often a gold session is among
    the first ``k``, and the mean share of gold sessions covered."""
    hit = F.coalesce(F.col("first_gold_rank") < k, F.lit(False)).cast("int")
    return coverage.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), PLACES).alias("hit_rate"), F.round(F.avg(F.col("covered") / F.greatest(F.lit(1), F.col("total"))), PLACES).alias("coverage"))


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000, seed: int = 17) -> DataFrame:
    """One row (mean_delta, low, high): the mean of (id, a, b)'s b - a and its 95 % interval.

    Every row draws its own Poisson(1) weight for each resample from a hash of its id, which is how a
    bootstrap is distributed: no resample is ever gathered, only ``resamples`` sums."""
    spark = pairs.sparkSession
    pairs = materialise(pairs.select("id", (F.col("b") - F.col("a")).alias("d")))  # read twice below
    cuts = [0.36787944117, 0.73575888234, 0.91969860292, 0.98101184312, 0.99634015317, 0.99940581518]
    spread = pairs.repartition(spark.sparkContext.defaultParallelism, "id")  # few bytes, but ``resamples`` draws a row
    draws = spread.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
    draws = draws.withColumn("u", (F.pmod(F.xxhash64(F.lit(seed), "s", "id"), F.lit(1 << 30)) + 0.5) / float(1 << 30))
    weight = sum(((F.col("u") > c).cast("int") for c in cuts), F.lit(0))
    means = draws.withColumn("w", weight).groupBy("s").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    bounds = means.agg(F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY m)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY m)").alias("high"))
    mean = pairs.agg(F.avg("d")).first()[0]
    return bounds.select(F.round(F.lit(mean).cast("double"), PLACES).alias("mean_delta"), *[F.round(c, PLACES).alias(c) for c in ("low", "high")])


def seeded_sample(rows: DataFrame, category: str, key: str, n: int, seed: int = 17) -> DataFrame:
    """``n`` rows of each category, by the hash of seed and key."""
    w = W.partitionBy(category).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def render_turns(turns: DataFrame) -> DataFrame:
    """(session, rendered): turns (session, pos, role, date, text) as dated lines, in order."""
    line = F.concat(F.lit("["), F.col("date").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))), lambda x: x["l"])  # one session
    return turns.groupBy("session").agg(F.array_join(lines, "\n").alias("rendered"))


def render_memories(evidence: DataFrame, dated: bool = False) -> DataFrame:
    """(query_id, rendered): texts of (query_id, rank, text, date) numbered in the order of their ranks, with
    their dates if ``dated``."""
    date = F.coalesce(F.col("date").cast("string"), F.lit("unknown date"))
    number = F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("string")
    head = F.concat(F.lit("[memory "), number, *([F.lit(" — "), date] if dated else []), F.lit("] "), F.col("text"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda x: x["part"])  # one answer's evidence
    return evidence.withColumn("part", head).groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("rendered"))


def render_sessions(evidence: DataFrame) -> DataFrame:
    """(query_id, rendered): texts of (query_id, rank, text, date, session) by session under its date, sessions
    in the order of their dates, texts in that of their ranks."""
    dated = evidence.withColumn("date", F.coalesce(F.col("date").cast("string"), F.lit("unknown")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("- "), F.col("text")).alias("line")))), lambda x: x["line"])
    groups = dated.groupBy("query_id", "date", "session").agg(F.min("rank").alias("first"), F.array_join(lines, "\n").alias("body"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("date", "first", "body"))), lambda x: F.concat(F.lit("[session of "), x["date"], F.lit("]\n"), x["body"]))  # one answer's evidence
    return groups.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("rendered"))
