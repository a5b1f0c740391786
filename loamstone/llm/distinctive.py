"""How distinctive a term is for a record: hypergeometric enrichment.

A record of n tokens is a draw from the collection's N tokens, of which K are the term. The score is
the negative log10 of the probability that at least the observed number are the term, adjusted for the
number of terms tested in the record (Benjamini-Hochberg). Terms are counted where a text is read and
stay together with their record; only partial counts of terms are shuffled. The tail probabilities are
computed by vectorised log-gamma sums.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.tokens import TOKEN, batches
from loamstone.session import materialise, one_row_per_key

# Coefficients of the Stirling series of the log-gamma function.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)

#: Terms whose counts workers hold, whatever the collection: the most frequent ones. Those of the others,
#: none of which is in more than a hundred-thousandth of all (record, term) pairs, are joined.
HELD_TERMS = 100_000
#: Share of false discoveries up to which a term is called characteristic of a record: more likely so than not.
FALSE_SHARE = 0.5


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 1, to about 1e-13: the Stirling series at x + 8, carried back."""
    x = np.asarray(x, dtype=np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        shift += np.log(y)
        y = y + 1.0
    inv, inv2 = 1.0 / y, 1.0 / (y * y)
    series = np.zeros_like(y)
    for c in reversed(_STIRLING):
        series = series * inv2 + c
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series * inv - shift


_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, 4096.0)))])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! of whole numbers: a table of the small ones, the Stirling series beyond."""
    small = k < len(_FACTORIALS)
    out = _FACTORIALS[np.where(small, k, 0).astype(np.int64)]
    if not small.all():
        y = np.where(small, 1.0, k + 1.0)
        inv = 1.0 / y
        out = np.where(small, out, (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + inv * (_STIRLING[0] + inv * inv * (_STIRLING[1] + inv * inv * _STIRLING[2])))
    return out


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def upper_tail(total: np.ndarray, marked: np.ndarray, drawn: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """ln P(X >= seen) for X the marked among ``drawn`` of ``total``, ``marked`` of which are marked.

    The first term comes from log-gamma sums, the next from ratios of neighbours. Below the mean the
    lower tail is summed and complemented, so the sum always runs away from the mode and ends once its
    terms no longer count.
    """
    total, marked, drawn, seen = (np.asarray(a, dtype=np.float64) for a in (total, marked, drawn, seen))
    low, high = np.maximum(0.0, drawn + marked - total), np.minimum(marked, drawn)
    mean = drawn * marked / total
    up = seen > mean
    start = np.where(up, seen, seen - 1.0)
    valid = (start >= low) & (start <= high)
    s = np.where(valid, start, low)
    first = log_choose(marked, s) + log_choose(total - marked, drawn - s) - log_choose(total, drawn)
    acc, term, k = np.ones_like(s), np.ones_like(s), s.copy()
    live = np.flatnonzero(valid)
    while live.size:
        ki, mi, di, ti = k[live], marked[live], drawn[live], total[live]
        rising = up[live]
        more = (mi - ki) * (di - ki) / ((ki + 1.0) * (ti - mi - di + ki + 1.0).clip(min=1e-300))
        less = ki * (ti - mi - di + ki) / ((mi - ki + 1.0) * (di - ki + 1.0))
        term[live] *= np.where(rising, more, less).clip(min=0.0)
        k[live] += np.where(rising, 1.0, -1.0)
        acc[live] += term[live]
        live = live[term[live] > acc[live] * 1e-17]
    log_sum = np.minimum(first + np.log(acc), 0.0)
    with np.errstate(divide="ignore"):
        lower = np.where(valid, np.log1p(-np.minimum(np.exp(log_sum), 1.0)), 0.0)
    out = np.where(up, np.where(valid, log_sum, -np.inf), lower)
    return np.where(seen <= low, 0.0, out)


def adjusted(log_p: np.ndarray) -> np.ndarray:
    """Benjamini-Hochberg scores (-log10) of one record's tail probabilities, all of them its family."""
    m = len(log_p)
    order = np.argsort(log_p, kind="stable")
    q = log_p[order] + np.log(m / np.arange(1.0, m + 1))
    out = np.empty(m)
    out[order] = np.minimum(0.0, np.minimum.accumulate(q[::-1])[::-1]) / -math.log(10.0)
    return out + 0.0


_COUNTS = pa.schema([("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64()))])
_COUNTS_SQL = "doc_id bigint, doc_tokens bigint, terms array<string>, tfs array<bigint>"


def _count_terms(batch_iter):
    def rows():
        for batch in batch_iter:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = Counter(TOKEN.findall(text.lower()))
                if counts:
                    yield doc_id, counts.total(), list(counts), list(counts.values())

    yield from batches(rows(), _COUNTS, 500)


_SCORED = pa.schema([("doc_id", pa.int64()), ("term", pa.string()), *((n, pa.int64()) for n in ("tf", "doc_tokens", "df", "cf")), ("log_p", pa.float64()), ("score", pa.float64())])
_SCORED_SQL = "doc_id bigint, term string, tf bigint, doc_tokens bigint, df bigint, cf bigint, log_p double, score double"


def _score(batch_iter, held, total: int, least_tf: int):
    """Scores of all terms of every record; rows of those that occur ``least_tf`` times."""
    words, held_df, held_cf = held.value
    for batch in batch_iter:
        terms, rare = batch.column("terms"), batch.column("rare")
        flat, counts = terms.flatten(), np.diff(terms.offsets.to_numpy())
        tf = batch.column("tfs").flatten().to_numpy()
        n = np.repeat(batch.column("doc_tokens").to_numpy(), counts)
        place = pc.index_in(flat, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
        df, cf = held_df[place], held_cf[place]
        missing = np.flatnonzero(place < 0)
        if len(missing):
            row = np.repeat(np.arange(batch.num_rows), counts)[missing]
            known = {(i, r["term"]): (r["df"], r["cf"]) for i in np.unique(row).tolist() for r in rare[i].as_py()}
            df[missing], cf[missing] = np.array([known[k] for k in zip(row.tolist(), flat.take(pa.array(missing)).to_pylist())]).T
        log_p = upper_tail(np.full(len(tf), float(total)), cf, n, tf)
        edges = np.cumsum([0, *counts.tolist()]).tolist()
        score = np.concatenate([adjusted(log_p[a:b]) for a, b in zip(edges, edges[1:])])
        rows = np.flatnonzero(tf >= least_tf)
        ids = np.repeat(batch.column("doc_id").to_numpy(), counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), flat.take(pa.array(rows)), *(pa.array(x[rows]) for x in (tf, n, df, cf, log_p, score))], schema=_SCORED)


def _with_rare(counted: DataFrame, held, rest: DataFrame | None) -> DataFrame:
    """Counted records and the column ``rare``: the collection's counts of their terms that are not held."""
    if rest is None:
        return counted.withColumn("rare", F.lit(None).cast("array<struct<term:string,df:bigint,cf:bigint>>"))

    def unheld(batch_iter):
        for batch in batch_iter:
            terms = batch.column("terms")
            flat = terms.flatten()
            rows = pa.array(np.flatnonzero(pc.is_null(pc.index_in(flat, value_set=held.value[0])).to_numpy(zero_copy_only=False)))
            ids = np.repeat(batch.column("doc_id").to_numpy(), np.diff(terms.offsets.to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(ids).take(rows), flat.take(rows)], names=["doc_id", "term"])

    pairs = counted.select("doc_id", "terms").mapInArrow(unheld, "doc_id bigint, term string").join(rest, "term")
    rare = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("term", "df", "cf")).alias("rare"))  # the terms of one text
    return counted.join(materialise(rare), "doc_id", "left").select(*counted.columns, "rare")


def distinctive_terms(docs: DataFrame, least_tf: int = 1, held_terms: int = HELD_TERMS) -> DataFrame:
    """(doc_id, term, tf, doc_tokens, df, cf, log_p, score) for every distinct token of every text, or for
    those that occur ``least_tf`` times in it (scored among all of its terms).

    ``docs`` needs ``doc_id`` (bigint) and ``text``; tokens are lower-cased. ``df`` and ``cf`` count the
    whole collection, ``log_p`` is the natural log of the tail probability and ``score`` the negative
    log10 of the adjusted one (0: no more than chance). Null texts, texts without tokens and rows
    without a document give nothing; a repeated document counts once. Workers hold the counts of
    ``held_terms`` terms, which does not change the result.
    """
    docs = one_row_per_key(docs.select("doc_id", "text"), "doc_id").filter("text is not null")
    counted = materialise(docs.mapInArrow(_count_terms, _COUNTS_SQL))
    total = counted.agg(F.coalesce(F.sum("doc_tokens"), F.lit(0))).first()[0]
    each = counted.select(F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.tfs").alias("tf"))
    stats = materialise(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))
    top = stats.orderBy(F.col("df").desc(), "term").limit(held_terms).collect()
    rest = None
    if len(top) == held_terms:
        least, last = top[-1]["df"], top[-1]["term"]
        rest = stats.filter((F.col("df") < least) | (F.col("df") == least) & (F.col("term") > last))
    figures = [np.array([r[c] for r in top], np.int64) if top else np.zeros(1, np.int64) for c in ("df", "cf")]
    held = docs.sparkSession.sparkContext.broadcast((pa.array([r["term"] for r in top], pa.string()), *figures))
    return _with_rare(counted, held, rest).mapInArrow(lambda it: _score(it, held, total, least_tf), _SCORED_SQL)


def top_terms(scored: DataFrame, per_doc: int) -> DataFrame:
    """The ``per_doc`` most distinctive terms of each record, ties by term."""
    w = W.partitionBy("doc_id").orderBy(F.col("score").desc(), "log_p", "term")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_doc)


def is_word(term: Column, least_chars: int = 4) -> Column:
    """A token of some length without digits or underscore."""
    return (F.length(term) >= least_chars) & ~F.regexp_like(term, F.lit(r"[\p{Nd}_]"))


def characteristic(scored: DataFrame, tf: int = 3, least_df: int = 2, most_df: int = 12, false_share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, term) of words that are enriched in a record (by their adjusted score, up to a share of false
    discoveries), frequent in it, and in a few records of the collection."""
    enriched = F.col("score") >= -math.log10(false_share)
    return scored.filter(enriched & is_word(F.col("term")) & (F.col("tf") >= tf) & F.col("df").between(least_df, most_df)).select("doc_id", "term")
