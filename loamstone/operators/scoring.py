"""BM25 of many queries at once over chunks kept with their tokens.

The forward index has a row a chunk, so a task holds whole chunks and can score and rank them by itself.
For every batch of chunks the words of the queries are inverted, each query's scores are summed over the chunks
that can pass its threshold, and only chunks that may be among the query's best leave the task. A threshold is
the n-th best score of the task so far, and every batch can only raise it; queries of the same words are scored
once. Nothing of the size queries x chunks is ever shuffled, however common the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.functions.text import index_tokens

# The usual parameters of BM25.
K1, B = 1.2, 0.75
#: (query, word) pairs that workers hold at once; more queries are scored in several passes.
QUERY_WORDS = 500_000
#: Chunks scored together.
BATCH = 20_000
#: A word of more than one chunk in so many has a row of its impacts in all chunks of a batch.
COMMON = 16
#: Words of no more than one chunk in so many together are summed without a pass over all chunks of a batch.
SPARSE = 8
#: Scores that a task keeps to know the n-th best of its queries; if they are more, only each batch's n-th counts.
HELD_SCORES = 8_000_000
#: Rows that a task holds back, and that it returns at once.
HELD_ROWS, OUT_ROWS = 2_000_000, 65_536
#: Scores this near to the threshold are kept; ranks are decided on rounded scores.
_SLACK = 1e-5


def forward_index(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, tokens): every chunk with its tokens in order."""
    return chunks.select("doc_id", "chunk_idx", index_tokens("chunk_text").alias("tokens"))


def forward_stats(forward: DataFrame) -> DataFrame:
    """One row (n_chunks, avgdl). Chunks without tokens count."""
    return forward.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size("tokens")).alias("avgdl"))


def forward_postings(forward: DataFrame) -> DataFrame:
    """(term, doc_id, chunk_idx, tf, dl) of a forward index."""
    rows = forward.select("doc_id", "chunk_idx", F.size("tokens").cast("bigint").alias("dl"), F.explode("tokens").alias("term"))
    return rows.groupBy("term", "doc_id", "chunk_idx", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(forward: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, df): chunks that have the term, of ``terms`` only if given. Counted in map-side sums, no
    chunk's words are shuffled."""
    words = forward.select(F.explode(F.array_distinct("tokens")).alias("term"))
    if terms is not None:
        words = words.join(terms.select("term").distinct(), "term", "left_semi")
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


class _Queries:
    """A block of queries for the workers: its words, and the pairs (query, word, weight) as arrays by query.

    Queries of the same words are one: the numbers of those that query ``q`` stands for are
    ``same[upto[q] : upto[q] + times[q]]``."""

    def __init__(self, rows: pa.Table):
        ids, terms = (rows.column(c).combine_chunks().dictionary_encode("encode") for c in ("query_id", "term"))
        query, term, weight = ids.indices.to_numpy(), terms.indices.to_numpy(), rows.column("w").to_numpy()
        order = np.lexsort((term, query))
        query, term, weight = query[order], term[order], weight[order]
        edges = np.searchsorted(query, np.arange(len(ids.dictionary) + 1)).tolist()
        group: dict = {}
        for q, (a, b) in enumerate(zip(edges, edges[1:])):
            group.setdefault((term[a:b].tobytes(), weight[a:b].tobytes()), []).append(q)
        self.ids, self.words = ids.dictionary, terms.dictionary
        self.same = np.array([q for g in group.values() for q in g], np.int64)
        self.times = np.array([len(g) for g in group.values()], np.int64)
        self.upto = np.cumsum(self.times) - self.times
        lead = np.zeros(len(ids.dictionary), bool)
        lead[self.same[self.upto]] = True
        number = np.cumsum(lead) - 1  # groups are in the order of their first queries
        self.query, self.term, self.weight = number[query[lead[query]]], term[lead[query]], weight[lead[query]]
        self.start = np.searchsorted(self.query, np.arange(len(self.times)))

    def expand(self, q: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The rows of ``q`` as often as they stand for queries, and the ids of these."""
        times = self.times[q]
        rows = np.repeat(np.arange(len(q)), times)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        return rows, self.ids.take(pa.array(self.same[self.upto[q[rows]] + place]))


class _Best:
    """What a task knows of each query's best scores so far: no chunk under ``least`` can be among the ``n`` best."""

    def __init__(self, queries: int, n: int):
        self.n, self.least = n, np.zeros(queries)
        self.held = np.zeros((queries, n)) if queries * n <= HELD_SCORES else None

    def add(self, q: int, scores: np.ndarray) -> None:
        known = scores if self.held is None else np.concatenate((self.held[q], scores))
        if len(known) > self.n:
            top = np.partition(known, len(known) - self.n)[len(known) - self.n :]
            self.least[q] = max(self.least[q], top[0])
            if self.held is not None:
                self.held[q] = top


def _score_batch(batch: pa.RecordBatch, queries: _Queries, best: _Best, avgdl: float):
    """(query numbers, chunk rows, scores) of a batch's chunks that may be among their query's best.

    What a word can add to a score at most is known from the batch. Chunks that have but words which together
    stay under the threshold of the query are never looked at, nor are queries all of whose words do."""
    rows, tokens, n_words = batch.num_rows, batch.column("tokens"), len(queries.words)
    dl = np.diff(tokens.offsets.to_numpy()).astype(np.float64)
    found = pc.index_in(tokens.flatten(), value_set=queries.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.repeat(np.arange(rows), dl.astype(np.int64))
    used = found >= 0
    key, tf = np.unique(found[used] * rows + chunk[used], return_counts=True)
    term, chunk = key // rows, key % rows
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[chunk] / avgdl))
    edges = np.searchsorted(term, np.arange(n_words + 1))
    present = np.flatnonzero(np.diff(edges))
    if not len(present):
        return None
    most = np.zeros(n_words)
    most[present] = np.maximum.reduceat(impact, edges[present])
    common = {}  # their number is bounded by the batch's tokens

    def row_of(t: int, a: int, b: int) -> np.ndarray:
        row = common.get(t)
        if row is None:
            row = common[t] = np.zeros(rows)
            row[chunk[a:b]] = impact[a:b]
        return row

    reach = queries.weight * most[queries.term]
    floor = np.maximum(0.0, best.least - _SLACK)
    bound = np.add.reduceat(reach, queries.start)
    pairs = np.flatnonzero((reach > 0) & (bound > floor)[queries.query])
    pairs = pairs[np.lexsort((reach[pairs], queries.query[pairs]))]
    query, reach = queries.query[pairs], reach[pairs]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    upto = np.cumsum(reach)
    upto -= np.repeat(upto[first] - reach[first], np.diff(first, append=len(query)))
    spare = np.add.reduceat((upto <= floor[query] - _SLACK).astype(np.int64), first) if len(first) else first
    word = queries.term[pairs]
    low, high, weight = edges[word].tolist(), edges[word + 1].tolist(), queries.weight[pairs].tolist()
    word, upto = word.tolist(), upto.tolist()
    out_q, out_c, out_s = [], [], []
    score, part, few = np.empty(rows), np.empty(rows), np.zeros(rows)
    for q, a, some, b in zip(query[first].tolist(), first.tolist(), spare.tolist(), [*first[1:].tolist(), len(pairs)]):
        least, a0 = floor[q], a + some
        enough = max(0.0, least - upto[a0 - 1] - _SLACK) if some else least
        if b - a0 == 1:
            at, s = chunk[low[a0] : high[a0]], weight[a0] * impact[low[a0] : high[a0]]
        elif sum(high[a0:b]) - sum(low[a0:b]) <= rows // SPARSE:
            places, at, s = [chunk[low[i] : high[i]] for i in range(a0, b)], [], []
            for i, c in enumerate(places, a0):
                few[c] += weight[i] * impact[low[i] : high[i]]
            for c in places:
                v = few[c]
                few[c] = 0.0  # so that the words after it leave this one's chunks out
                over = v > enough
                at.append(c[over])
                s.append(v[over])
            at, s = np.concatenate(at), np.concatenate(s)
        else:
            score[:] = 0.0
            for i in range(a0, b):
                if high[i] - low[i] > rows // COMMON:
                    score += np.multiply(row_of(word[i], low[i], high[i]), weight[i], out=part)
                else:
                    score[chunk[low[i] : high[i]]] += weight[i] * impact[low[i] : high[i]]
            at = np.flatnonzero(score > enough)
            s = score[at]
        for i in range(a0 - 1, a - 1, -1):
            left = s > least - upto[i] - _SLACK
            at, s = at[left], s[left]
            if not len(at):
                break
            if high[i] - low[i] > rows // COMMON:
                s = s + weight[i] * row_of(word[i], low[i], high[i])[at]
            else:
                have = chunk[low[i] : high[i]]
                place = np.minimum(np.searchsorted(have, at), len(have) - 1)
                s = s + weight[i] * impact[low[i] : high[i]][place] * (have[place] == at)
        keep = s > least
        at, s = at[keep], s[keep]
        if len(at):
            best.add(q, s)
            if best.least[q] - _SLACK > least:
                keep = s > best.least[q] - _SLACK
                at, s = at[keep], s[keep]
            out_q.append(np.full(len(at), q))
            out_c.append(at)
            out_s.append(s)
    return [np.concatenate(x) for x in (out_q, out_c, out_s)] if out_q else None


def _of_size(batches, n: int):
    """The rows of Arrow batches in batches of ``n``."""
    some, size = [], 0
    for whole in batches:
        some.append(whole)
        size += whole.num_rows
        while size >= n:
            table = pa.Table.from_batches(some)
            yield table.slice(0, n).combine_chunks().to_batches()[0]
            some, size = table.slice(n).to_batches(), size - n
    if size:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _scored(batches, queries: _Queries, avgdl: float, n: int):
    """Arrow batches (query_id, doc_id, chunk_idx, s) of a task's batches of chunks; rows are held back while they
    fit, so that later batches can rule them out."""
    best, kept, size = _Best(len(queries.times), n), [], 0

    def still(q: np.ndarray, s: np.ndarray, columns: list) -> tuple:
        at = np.flatnonzero(s > best.least[q] - _SLACK)
        return q[at], s[at], [c.take(pa.array(at)) for c in columns]

    def ready():
        for q, s, columns in kept:
            for at in range(0, len(q), OUT_ROWS):
                rows, ids = queries.expand(q[at : at + OUT_ROWS])
                rows = pa.array(rows + at)
                yield pa.RecordBatch.from_arrays([ids, *[c.take(rows) for c in columns], pa.array(s).take(rows)], names=["query_id", "doc_id", "chunk_idx", "s"])

    for batch in batches:
        found = _score_batch(batch, queries, best, avgdl)
        if found is None:
            continue
        q, c, s = found
        kept.append((q.astype(np.int32), s, [batch.column(x).take(pa.array(c)) for x in ("doc_id", "chunk_idx")]))
        size += len(q)
        if size > HELD_ROWS:
            kept = [still(*k) for k in kept]
            size = sum(len(k[0]) for k in kept)
            if size > HELD_ROWS // 2:
                yield from ready()
                kept, size = [], 0
    kept = [still(*k) for k in kept]
    yield from ready()


def best_scored(weights: DataFrame, forward: DataFrame, avgdl: float, n: int) -> DataFrame:
    """(query_id, doc_id, chunk_idx, raw_score): the ``n`` best chunks of each query and some more, all that
    share the n-th score included. ``weights`` has (query_id, term, w)."""
    spark = forward.sparkSession
    blocks = max(1, -(-weights.count() // QUERY_WORDS))
    kinds = {f.name: f.dataType.simpleString() for f in [weights.schema["query_id"], forward.schema["doc_id"], forward.schema["chunk_idx"]]}
    out, tasks = None, spark.sparkContext.defaultParallelism  # every task returns the best of its chunks: no more tasks than run at once
    for b in range(blocks):
        part = weights.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) if blocks > 1 else weights
        shared = spark.sparkContext.broadcast(_Queries(part.select("query_id", "term", "w").toArrow()))  # at most about QUERY_WORDS rows

        def score(batch_iter, shared=shared):
            return _scored(_of_size(batch_iter, BATCH), shared.value, avgdl, n)

        scored = forward.select("doc_id", "chunk_idx", "tokens").coalesce(tasks).mapInArrow(score, ", ".join(f"{k} {v}" for k, v in kinds.items()) + ", s double")
        out = scored if out is None else out.unionByName(scored)
    return out
