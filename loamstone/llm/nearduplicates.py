"""Near-duplicate records with small edits: pigeonhole blocks.

A text is the set of its runs of five consecutive lower-cased tokens. Its fingerprint has 192 slots,
each the least value of the set under one hash function; two slots agree with probability equal to the
sets' resemblance. Fingerprints are split into 64 blocks of 3 slots. If fewer than 64 slots differ, a
block is free of differences for certain (pigeonhole); if more differ, two texts of resemblance s still
miss every block only with probability (1 - s^3)^64, which is 2e-7 at 0.6 and 4e-20 at 0.8. Texts that
share a block are compared by the Hamming distance of their 192-bit forms (one bit a slot), and those
within reach by their whole sets. Blocks that very many texts share, as a common template makes them, are
not paired: their texts are compared by their rarest runs instead, by which no similar pair is lost.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.tokens import TOKEN
from loamstone.operators.components import connected_components
from loamstone.session import materialise, one_row_per_key

WORDS = 5
SIMILARITY = 0.8
BLOCKS, ROWS = 64, 3
SLOTS = BLOCKS * ROWS
#: Standard deviations by which the Hamming distance of a true pair may exceed its mean.
SIGMAS = 5.5
#: A block shared by more texts than this is joined cell by cell of a grid.
CELL = 256

#: A block shared by more texts than this is not paired; its texts meet by their rarest runs.
HOT_BLOCK = 10_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, SLOTS, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _scramble(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products spread over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX[0]
    h = h ^ (h >> np.uint64(29))
    h = h * _MIX[1]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """64-bit hashes of the runs of ``words`` tokens of texts; token hashes are kept a while."""

    def __init__(self, words: int = WORDS):
        self.words, self.known = words, {}

    def token_hashes(self, text: str) -> list[int]:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for t in TOKEN.findall(text.lower()):
            x = known.get(t)
            if x is None:
                x = known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"))
            out.append(x)
        return out

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """The distinct run hashes of each text, in ascending order."""
        each = [self.token_hashes(t) for t in texts]
        h = np.array([x for e in each for x in e], np.uint64)
        n = max(0, len(h) - self.words + 1)
        acc = np.zeros(n, np.uint64)
        for j in range(self.words):
            acc = acc * _MIX[2] + h[j : j + n]
        acc = _scramble(acc)
        out, at = [], 0
        for e in each:
            out.append(np.unique(acc[at : at + max(0, len(e) - self.words + 1)]))  # runs across texts are left out
            at += len(e)
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of slots for each (non-empty) set: the least of every hash function over it."""
    edges = np.cumsum([0, *map(len, sets)])[:-1]
    h = np.concatenate(sets)
    slots = np.empty((SLOTS, len(sets)), np.uint64)
    for k in range(SLOTS):
        x = h * _MULTIPLY[k]
        x += _ADD[k]
        x ^= x >> np.uint64(32)
        slots[k] = np.minimum.reduceat(x, edges)
    return np.ascontiguousarray(slots.T)


def block_keys(slots: np.ndarray) -> np.ndarray:
    """A 64-bit key a block and text, different from block to block."""
    rows = slots.reshape(len(slots), BLOCKS, ROWS)
    acc = np.arange(1, BLOCKS + 1, dtype=np.uint64) * _MIX[4] + np.zeros((len(slots), 1), np.uint64)
    for j in range(ROWS):
        acc = _scramble(acc * _MIX[5] + rows[:, :, j])
    return acc


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bit0", pa.int64()), ("bit1", pa.int64()), ("bit2", pa.int64()), ("blocks", pa.list_(pa.int64()))])
_SKETCH_SQL = "doc_id bigint, n bigint, set_a bigint, set_b bigint, bit0 bigint, bit1 bigint, bit2 bigint, blocks array<bigint>"
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_SETS_SQL = "doc_id bigint, shingles array<bigint>"


#: Shingles that are fingerprinted at once; a longer text is a group of its own.
_GROUP = 20_000


def _shingled(batch_iter, words: int, to_batch):
    """What ``to_batch`` makes of the ids and run sets of some texts at a time."""
    shingler = Shingler(words)
    for batch in batch_iter:
        ids, texts = (c.to_pylist() for c in batch.columns)
        group, chars = [], 0
        for i, text in enumerate(texts):
            group.append(i)
            chars += len(text)
            if chars > 5 * _GROUP or i + 1 == len(texts):
                sets = shingler.many([texts[k] for k in group])
                kept = [(ids[k], s) for k, s in zip(group, sets) if len(s)]
                group, chars = [], 0
                if kept:
                    yield to_batch([k for k, _ in kept], [s for _, s in kept])


def _lists(flat: np.ndarray, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(flat, pa.int64()))


def _sketch_batch(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    slots = fingerprints(sets)
    bits = np.ascontiguousarray(np.packbits((slots >> np.uint64(11)).astype(np.uint8) & 1, axis=1)).view(np.int64)
    keys = block_keys(slots).view(np.int64)
    sums = [(s.sum(dtype=np.uint64), (s * _MIX[6] ^ (s >> np.uint64(17))).sum(dtype=np.uint64)) for s in sets]
    columns = [
        pa.array(ids, pa.int64()),
        pa.array([len(s) for s in sets], pa.int64()),
        *(pa.array(np.array([x[k] for x in sums], np.uint64).view(np.int64)) for k in (0, 1)),
        *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(3)),
        _lists(keys.reshape(-1), [BLOCKS] * len(ids)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SKETCH)


def _set_batch(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets])], schema=_SETS)


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprint and set identity of every text of ``words`` tokens or more, written once. ``docs`` has a row
    a document."""
    return materialise(docs.mapInArrow(lambda it: _shingled(it, words, _sketch_batch), _SKETCH_SQL))


def run_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids``, made from their texts again."""
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(lambda it: _shingled(it, words, _set_batch), _SETS_SQL)


def shared_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, _n) of the keys of two rows or more, counted in map-side sums."""
    return materialise(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"))


def pairs_within(rows: DataFrame, key: str, item: str, cell: int = CELL, counts: DataFrame | None = None) -> DataFrame:
    """(a, b), a < b: the pairs of different items under the same key, repeats left in; of the keys in
    ``counts`` only if those are known (see :func:`shared_keys`).

    Keys of one row are dropped before the join. A key of more than ``cell`` rows is spread over a grid:
    its items fall into parts, and parts i <= j meet in their own cell, so no task gets a key whole.
    """
    counts = shared_keys(rows, key) if counts is None else counts
    counts = counts.select(key, F.ceil(F.col("_n") / cell).cast("int").alias("_g"))
    known = rows.select(key, item).join(counts, key).withColumn("_p", F.pmod(F.xxhash64(item), F.col("_g")).cast("int"))
    known = materialise(known)
    left = known.select(key, F.col(item).alias("_a"), F.col("_p").alias("_i"), F.explode(F.sequence("_p", F.col("_g") - 1)).alias("_j"))
    right = known.select(key, F.col(item).alias("_b"), F.col("_p").alias("_j"), F.explode(F.sequence(F.lit(0), "_p")).alias("_i"))
    met = left.join(right, [key, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("_a") < F.col("_b"))).filter("_a <> _b")
    return met.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))


def most_differing(similarity: float) -> int:
    """Hamming distance of the 192-bit forms up to which a pair may have ``similarity`` or more."""
    p = (1 - similarity) / 2
    return int(SLOTS * p + SIGMAS * (SLOTS * p * (1 - p)) ** 0.5) + 1


def by_rarest_runs(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: pairs of ``sets`` (doc_id, shingles) that share one of their rarest runs, every pair of
    ``similarity`` or more among them: such sets share ``similarity`` of the larger, so in any order of all
    runs the first of one's beyond that share meet the first of the other's."""
    t = Fraction(str(similarity))
    runs = sets.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("run"))
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("texts"))
    placed = runs.join(counts, "run").withColumn("at", F.row_number().over(W.partitionBy("doc_id").orderBy("texts", "run")))
    needed = F.expr(f"(n * {t.numerator} + {t.denominator - 1}) div {t.denominator}")
    first = placed.filter((F.col("at") <= F.col("n") - needed + 1) & (F.col("texts") > 1))
    return pairs_within(first.select("doc_id", F.col("run").alias("key")), "key", "doc_id")


def similar_classes(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(rep, doc_id) for the classes of texts with equal sets, and (a, b, shared, united): the linked
    pairs of class representatives with the sizes of their intersection and union."""
    docs = one_row_per_key(docs.select("doc_id", "text"), "doc_id").filter("text is not null")
    sketch = sketches(docs, words)
    classes = sketch.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("rep"))
    members = materialise(sketch.select("doc_id", "set_a", "set_b", "n").join(classes, ["set_a", "set_b", "n"]).select("rep", "doc_id"))
    reps = members.filter("rep = doc_id").select("doc_id")
    keys = sketch.join(reps, "doc_id", "left_semi").select("doc_id", F.explode("blocks").alias("key"))
    counts = shared_keys(keys, "key")
    candidates = pairs_within(keys, "key", "doc_id", counts=counts.filter(F.col("_n") <= HOT_BLOCK))
    hot = counts.filter(F.col("_n") > HOT_BLOCK).select("key")  # few: each has that many texts
    if not hot.isEmpty():
        crowded = materialise(keys.join(hot, "key", "left_semi").select("doc_id").distinct())
        candidates = candidates.union(by_rarest_runs(materialise(run_sets(docs, crowded, words)), similarity))
    bits = ["n", "bit0", "bit1", "bit2"]
    form = lambda x: sketch.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in bits])
    met = candidates.distinct().join(form("a"), "a").join(form("b"), "b")
    distance = sum((F.bit_count(F.col(f"a_bit{i}").bitwiseXOR(F.col(f"b_bit{i}"))) for i in range(3)), F.lit(0))
    t = Fraction(str(similarity))
    sizes = F.least("a_n", "b_n") * t.denominator >= F.greatest("a_n", "b_n") * t.numerator
    near = materialise(met.filter((distance <= most_differing(similarity)) & sizes).select("a", "b", "a_n", "b_n"))
    sets = materialise(run_sets(docs, near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct(), words))
    checked = near.join(sets.toDF("a", "a_set"), "a").join(sets.toDF("b", "b_set"), "b")
    checked = checked.withColumn("shared", F.size(F.array_intersect("a_set", "b_set")).cast("bigint")).withColumn("united", F.col("a_n") + F.col("b_n") - F.col("shared"))
    links = checked.filter(F.col("shared") * t.denominator >= F.col("united") * t.numerator).select("a", "b", "shared", "united")
    return members, materialise(links)


def near_duplicate_pairs(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_a, doc_b), smaller first: all pairs of documents whose sets of ``words``-token runs share
    ``similarity`` of their union, copies included.

    Texts of fewer tokens have an empty set and no pairs; null texts and rows without a document are
    dropped; a repeated document counts once.
    """
    members, links = similar_classes(docs, similarity, words)
    same = pairs_within(members, "rep", "doc_id")
    side = lambda x: members.select(F.col("rep").alias(x), F.col("doc_id").alias(f"doc_{x}"))
    across = links.join(side("a"), "a").join(side("b"), "b")
    across = across.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))
    return same.toDF("doc_a", "doc_b").unionByName(across)


def near_duplicate_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_id, class_id, group_id, links): every document with its class of equal sets (its smallest
    document), its group of linked classes (the smallest document of all) and the number of classes its
    own is linked to. Documents too short for a run stand alone."""
    members, links = similar_classes(docs, similarity, words)
    groups = connected_components(links, "a", "b").select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    degree = links.select(F.col("a").alias("class_id")).union(links.select("b")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().join(members, "doc_id", "left")
    ids = ids.select("doc_id", F.coalesce("rep", "doc_id").alias("class_id")).join(groups, "class_id", "left").join(degree, "class_id", "left")
    return ids.select("doc_id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
