"""Evaluation texts leaking into training text: latent semantic retrieval.

Passages are windows of 13 tokens at every position. Item passages are rows of a TF-IDF matrix over hashed
terms whose weights count the whole corpus; a randomised SVD of it, its products summed over distributed
rows, gives a latent space of some hundred dimensions. Item passages lie in an index in the shared folder,
in cells around leaders; a cell's passages are read by the workers whose windows come near it. One pass over
the corpus folds every window of every document into the space and searches it for item passages of high
cosine. A window that repeats an item's 13 tokens has the same vector, so its cosine is 1 whatever the rank.
Candidate pairs are then checked on their tokens: the longest common run, and near every window found the
longest common subsequence and whether the answer occurs.
"""

from __future__ import annotations

import math
import uuid
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.tokens import TOKEN, batches
from loamstone.session import materialise, one_row_per_key, remove_at_exit, shared_dir

RUN = 13
RANK = 96
COSINE = 0.7
LCS_SHARE = 0.6
#: Terms are told apart by 64-bit hashes; the latent space knows them by this many slots.
SLOTS = 1 << 16
#: Item passages, drawn by hash, among which leaders are chosen: what of the index every worker holds.
LEADER_SAMPLE = 8192
#: Passages of a file of the index, and items' tokens of a file of their texts.
FILE_ROWS, FILE_TOKENS = 32_768, 1_000_000
#: Files of either kind that a worker keeps in memory.
HELD_FILES = 6
#: Tokens of an item that are searched as one section; sections overlap by a run.
SECTION = 4_000
#: Windows searched together.
WINDOWS = 4096


class Hasher:
    """64-bit hashes of the lower-cased tokens of texts; a token's hash is kept a while."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > 500_000:
            known.clear()
        for t in TOKEN.findall(text.lower()):
            h = known.get(t)
            if h is None:
                h = known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
            out.append(h)
        return np.array(out, np.int64)


def _sections(items: DataFrame) -> DataFrame:
    """(item_id, section, words, answer): hashed item tokens in overlapping sections."""
    schema = pa.schema([("item_id", pa.int64()), ("section", pa.int64()), ("words", pa.list_(pa.int64())), ("answer", pa.list_(pa.int64()))])

    def cut(batch_iter):
        hashes = Hasher()

        def rows():
            for batch in batch_iter:
                for item_id, text, answer in zip(*(c.to_pylist() for c in batch.columns)):
                    words = hashes(text)
                    for at in range(0, max(1, len(words) - RUN + 1), SECTION):
                        part = words[at : at + SECTION + RUN - 1]
                        if len(part):
                            yield item_id, at, part, hashes(answer or "")

        yield from batches(rows(), schema, 1000)

    return items.mapInArrow(cut, "item_id bigint, section bigint, words array<bigint>, answer array<bigint>")


def _placed(place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Rows of the latent space for hashed tokens, -1 for those of no item."""
    return place[hashes & (SLOTS - 1)]


def _document_frequency(docs: DataFrame, place, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each slot of the items, and documents in all; one pass, sums by partition."""
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def count(batch_iter):
        hashes, total, out = Hasher(), 0, np.zeros(size + 1, np.int64)
        for batch in batch_iter:
            for text in batch.column(0).to_pylist():
                total += 1
                out[np.unique(_placed(place.value, hashes(text)))] += 1
        out[-1] = total  # where tokens of no item were counted
        yield from batches(((int(k) if k < size else -1, int(out[k])) for k in np.flatnonzero(out)), schema)

    rows = docs.select("text").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # a row a slot
    df, total = np.zeros(size), 0
    for r in rows:
        if r["slot"] < 0:
            total = r["n"]
        else:
            df[r["slot"]] = r["n"]
    return df, total


def window_sums(rows: np.ndarray, width: int) -> np.ndarray:
    """Sums over every window of ``width`` rows."""
    total = np.concatenate([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0, dtype=np.float64)])
    return total[width:] - total[:-width]


def _summed(passages: DataFrame, weights, matrix, gram: bool) -> np.ndarray:
    """A' A M (or, as ``gram``, M' A' A M) for the TF-IDF rows A of all item windows, summed over
    partitions: partial sums a partition, then one reducer a slice of terms."""
    size, width = matrix.value.shape
    schema = "slot bigint, v array<double>"

    def partial(frames):
        idf, m = weights.value, matrix.value
        scaled = idf[:, None] * m
        acc = np.zeros((width, width)) if gram else np.zeros((size, width))
        for pdf in frames:
            for ids in pdf["ids"]:
                ids = np.asarray(ids, np.int64)
                w = min(RUN, len(ids))
                product = window_sums(scaled[ids], w)  # rows of A M
                if gram:
                    acc += product.T @ product
                else:  # a token at position i is in the windows that begin at i - w + 1 .. i
                    padded = np.zeros((len(ids) + w - 1, width))
                    padded[w - 1 : w - 1 + len(product)] = product
                    np.add.at(acc, ids, idf[ids][:, None] * window_sums(padded, w)[: len(ids)])
        slots = np.flatnonzero(np.abs(acc).sum(axis=1))
        if len(slots):
            yield pd.DataFrame({"slot": slots, "v": pd.Series(acc[slots].tolist(), dtype=object)})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        slots, place = np.unique(pdf["slot"].to_numpy(), return_inverse=True)
        summed = np.zeros((len(slots), width))
        np.add.at(summed, place, np.stack(pdf["v"].to_list()))
        return pd.DataFrame({"slot": slots, "v": pd.Series(summed.tolist(), dtype=object)})

    parts = passages.mapInPandas(partial, schema)
    rows = parts.groupBy(F.pmod("slot", F.lit(16))).applyInPandas(total, schema).collect()  # a row a slot
    out = np.zeros((width, width) if gram else (size, width))
    for r in rows:
        out[r["slot"]] = r["v"]
    return out


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int, seed: int = 11, power: int = 1) -> np.ndarray:
    """Right singular vectors (terms x rank) of the TF-IDF matrix of item windows."""
    sc = passages.sparkSession.sparkContext
    weights = sc.broadcast(idf)
    width = min(rank + 8, len(idf))
    basis = np.random.default_rng(seed).standard_normal((len(idf), width))
    for _ in range(power + 1):
        basis, _ = np.linalg.qr(_summed(passages, weights, sc.broadcast(basis), False))
    gram = _summed(passages, weights, sc.broadcast(basis), True)
    _, vectors = np.linalg.eigh(gram)
    return basis @ vectors[:, ::-1][:, : min(rank, width)]


def longest_run(doc: np.ndarray, item: np.ndarray) -> int:
    """Length of the longest run of tokens common to both; unknown tokens (-1) match nothing.

    Places where runs of 1, 2, 4, ... tokens begin follow from each other; the longest length is put together
    from the largest of these. Long texts are compared token by token."""
    shared = np.isin(doc, item)
    shared[1:] |= shared[:-1]  # a token that parts runs follows each
    doc = doc[shared]
    if len(doc) * len(item) > 1 << 22:
        best, run = 0, np.zeros(len(doc) + 1, np.int32)
        for t in item:
            new = np.zeros_like(run)
            new[1:] = np.where(doc == t, run[:-1] + 1, 0)
            run = new
            best = max(best, int(run.max()))
        return best
    runs, here = [], doc[:, None] == item
    while here.any():
        runs.append(here)
        step = 1 << (len(runs) - 1)
        here = here[:-step, :-step] & here[step:, step:]
    if not runs:
        return 0
    here, length = runs[-1], 1 << (len(runs) - 1)
    for k in range(len(runs) - 2, -1, -1):
        more = runs[k][length:, length:]
        rows, columns = min(len(here), len(more)), min(here.shape[1], more.shape[1])
        longer = here[:rows, :columns] & more[:rows, :columns]
        if longer.any():
            here, length = longer, length + (1 << k)
    return length


def token_masks(item: np.ndarray) -> dict[int, int]:
    """The places of each token as bits of one integer."""
    masks: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        masks[t] = masks.get(t, 0) | (1 << i)
    return masks


def common_subsequence(doc: np.ndarray, item: np.ndarray, masks: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence, by bits of one integer (Hyyrö, 2004)."""
    masks = token_masks(item) if masks is None else masks
    full = (1 << len(item)) - 1
    v = full
    for t in doc.tolist():
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - bin(v).count("1")


#: Cosine of equal windows, rounding aside.
_REPEATED = 0.999
#: Item passages whose cosine to a leader is this or more need no leader of their own.
_GROUPED = 0.8


def choose_leaders(rows: np.ndarray) -> np.ndarray:
    """Unit vectors among ``rows`` such that every row is near one of them."""
    leaders = np.empty((0, rows.shape[1]), rows.dtype)
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        far = np.flatnonzero((part @ leaders.T).max(axis=1) < _GROUPED) if len(leaders) else np.arange(len(part))
        while len(far):
            leaders = np.concatenate([leaders, part[far[:1]]])
            far = far[part[far] @ leaders[-1] < _GROUPED]
    return leaders


def nearest_leader(rows: np.ndarray, leaders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest leader, angle to it) of unit vectors."""
    like = np.concatenate([rows[at : at + 4096] @ leaders.T for at in range(0, len(rows), 4096)])
    own = like.argmax(axis=1)
    return own, np.arccos(np.clip(like[np.arange(len(rows)), own], -1.0, 1.0))


def unit_windows(space: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    v = window_sums(space[ids], width)
    return (v / np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)[:, None]).astype(np.float32)


class _Files:
    """Tables of a folder by number, the latest few in memory."""

    def __init__(self, folder: str, column: str, load):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.column, self.load, self.held = column, load, OrderedDict()

    def __getitem__(self, number: int):
        if number in self.held:
            self.held.move_to_end(number)
        else:
            infos = self.system.get_file_info(fs.FileSelector(f"{self.path}/{self.column}={number}"))
            parts = [pq.read_table(i.path, filesystem=self.system, partitioning=None) for i in infos if i.path.endswith(".parquet")]
            self.held[number] = self.load(pa.concat_tables(parts))
            if len(self.held) > HELD_FILES:
                self.held.popitem(last=False)
        return self.held[number]


def _load_passages(t: pa.Table) -> dict:
    """Passages of a file by cell: (vectors, file and place of their sections)."""
    cell = t.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    vectors = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(len(cell), -1)[order]
    owner = np.stack([t.column("file").to_numpy(), t.column("pos").to_numpy()], axis=1)[order]
    cells, first = np.unique(cell[order], return_index=True)
    edges = [*first.tolist(), len(cell)]
    return {c: (vectors[a:b], owner[a:b]) for c, a, b in zip(cells.tolist(), edges, edges[1:])}


def _load_sections(t: pa.Table) -> dict:
    cols = (t.column(c).to_pylist() for c in ("pos", "item_id", "words", "answer"))
    return {p: (i, np.array(w, np.int64), np.array(a, np.int64)) for p, i, w, a in zip(*cols)}


class _Searcher:
    """Finds candidate items of documents through the index, and checks them."""

    def __init__(self, index: dict):
        self.place, self.idf, self.space, self.unknown = index["place"], index["idf"], index["space"], index["unknown"] ** 2
        self.leaders = index["leaders"]
        self.passages = _Files(index["folder"] + "/passages", "g", _load_passages)
        self.sections = _Files(index["folder"] + "/sections", "file", _load_sections)
        self.masks = lru_cache(maxsize=4096)(lambda file, pos: token_masks(self.sections[file][pos][1]))

    def windows(self, ids: np.ndarray, width: int, cosine: float):
        """(starts, unit vectors, fading) of the windows of a text that may reach the cosine, some at a time:
        terms of the items hold enough of their squared weight. A cosine is at most the square root of that
        share, its fading."""
        for at in range(0, len(ids) - width + 1, WINDOWS):
            some = ids[at : at + WINDOWS + width - 1]
            known = some >= 0
            if not known.any():
                continue
            mass = np.where(known, self.idf[some] ** 2, self.unknown)
            part = np.concatenate([[0.0], np.cumsum(np.where(known, mass, 0.0))])
            whole = np.concatenate([[0.0], np.cumsum(mass)])
            share = np.minimum(1.0, (part[width:] - part[:-width]) / (whole[width:] - whole[:-width]))
            starts = np.flatnonzero(share >= cosine * cosine - 1e-9)
            if len(starts):
                rows = np.where(known[:, None], self.space[some], np.float32(0))
                yield at + starts, unit_windows(rows, np.arange(len(some)), width)[starts], np.sqrt(share[starts]).astype(np.float32)

    def search(self, vectors: np.ndarray, faded: np.ndarray, width: int, cosine: float):
        """(window, section file, section place, cosine) of windows and item passages like them. The angle to a
        passage is at least the angle to its leader less the cell's radius, so none is lost."""
        leaders, radii, cells = self.leaders[width]
        reach = np.arccos(np.minimum(1.0, (cosine - 1e-5) / faded))
        near = np.concatenate([np.arccos(np.clip(vectors[at : at + 512] @ leaders.T, -1.0, 1.0)) <= reach[at : at + 512, None] + radii + 1e-3 for at in range(0, len(vectors), 512)])
        files: dict[int, list[int]] = {}
        for c in np.flatnonzero(near.any(axis=0)).tolist():
            for g in cells[c][1]:
                files.setdefault(g, []).append(c)
        out = []
        for g, some in files.items():
            held = self.passages[g]
            for c in some:
                if cells[c][0] not in held:  # a cell's passages fill several files
                    continue
                passages, owner = held[cells[c][0]]
                rows = np.flatnonzero(near[:, c])
                like = (vectors[rows] @ passages.T) * faded[rows, None]
                r, k = np.nonzero(like >= cosine - 1e-5)
                if len(r):
                    out.append((rows[r], owner[k, 0], owner[k, 1], like[r, k]))
        return [np.concatenate(x) for x in zip(*out)] if out else None

    def found(self, texts: list[np.ndarray], cosine: float):
        """(text number, {(file, place): [(window starts, best cosine)]}) of the texts with windows like item passages."""
        places = [_placed(self.place, t) for t in texts]
        hits: list[dict] = [{} for _ in texts]
        for width in self.leaders:
            todo: list[tuple] = []
            for n, ids in enumerate(places):
                for part in self.windows(ids, width, cosine):
                    todo.append((n, *part))
                    if sum(len(x[1]) for x in todo) >= WINDOWS:
                        self._gather(todo, width, cosine, hits)
                        todo = []
            self._gather(todo, width, cosine, hits)
        return [(n, h) for n, h in enumerate(hits) if h]

    def _gather(self, todo: list[tuple], width: int, cosine: float, hits: list[dict]) -> None:
        if not todo:
            return
        found = self.search(np.concatenate([x[2] for x in todo]), np.concatenate([x[3] for x in todo]), width, cosine)
        if found is None:
            return
        row, file, pos, value = found
        text = np.concatenate([np.full(len(x[1]), x[0]) for x in todo])[row]
        start = np.concatenate([x[1] for x in todo])[row]
        order = np.lexsort((start, pos, file, text))
        text, file, pos, start, value = (x[order] for x in (text, file, pos, start, value))
        first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (file[1:] != file[:-1]) | (pos[1:] != pos[:-1])])
        for a, b, top in zip(first.tolist(), [*first[1:].tolist(), len(text)], np.maximum.reduceat(value, first).tolist()):
            hits[text[a]].setdefault((int(file[a]), int(pos[a])), []).append((start[a:b], top))

    def _best(self, ids: np.ndarray, section: tuple[int, int], starts: list[int], least: float) -> int | None:
        """The longest subsequence of the item near one of the windows, if it is ``least`` or more. What
        stands near several windows together bounds what stands near each, so windows are halved only
        while their bound is above the best so far."""
        item, best = self.sections[section[0]][section[1]][1], None
        masks = self.masks(*section)
        far = [0, *(i for i in range(1, len(starts)) if starts[i] - starts[i - 1] > len(item)), len(starts)]
        todo = [(a, b) for a, b in zip(far, far[1:]) if a < b]
        while todo:
            a, b = todo.pop()
            near = ids[max(0, starts[a] - len(item)) : starts[b - 1] + RUN + len(item)]
            lcs = common_subsequence(near, item, masks)
            if lcs < least or (best is not None and lcs <= best):
                continue
            if b - a == 1:
                best = lcs
            else:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
        return best

    def _with_answer(self, ids: np.ndarray, section: tuple[int, int], starts: list[int]) -> list[int]:
        """The windows with the answer near them."""
        _, item, answer = self.sections[section[0]][section[1]]
        last = len(ids) - len(answer)
        if not len(answer) or last < 0:
            return []
        at = np.flatnonzero(np.logical_and.reduce([ids[k : last + 1 + k] == t for k, t in enumerate(answer)]))
        first = np.searchsorted(at, np.asarray(starts) - len(item))
        ends = [*(at + len(answer)).tolist(), math.inf]  # of the first answer that starts near the window, if any
        return [s for s, k in zip(starts, first.tolist()) if ends[k] <= s + RUN + len(item)]

    def check(self, ids: np.ndarray, section: tuple[int, int], windows: list[tuple[np.ndarray, float]], lcs_share: float) -> tuple[float, int, int, float, bool] | None:
        """(best cosine, longest run, subsequence, its share of the item, answer there), or None if the pair
        is neither: a repeated run has a window of cosine 1, a paraphrase enough of the item, and its
        answer if it has one, near one of its windows."""
        _, item, answer = self.sections[section[0]][section[1]]
        starts, top = np.unique(np.concatenate([w for w, _ in windows])).tolist(), max(c for _, c in windows)
        answered = self._with_answer(ids, section, starts)
        lcs = self._best(ids, section, answered if len(answer) else starts, lcs_share * len(item))
        if lcs is None and top < _REPEATED:
            return None
        run = longest_run(ids, item)
        if lcs is None:
            if run < RUN:
                return None
            lcs = self._best(ids, section, starts, 0)
        return top, run, lcs, lcs / len(item), bool(answered)


_PASSAGE = pa.schema([("width", pa.int32()), ("leader", pa.int64()), ("angle", pa.float64()), ("part", pa.int64()), ("file", pa.int64()), ("pos", pa.int64()), ("v", pa.binary())])
_PASSAGE_SQL = "width int, leader bigint, angle double, part bigint, file bigint, pos bigint, v binary"


def _build_index(sections: DataFrame, docs: DataFrame, rank: int) -> dict | None:
    """Writes the index of all item passages to the shared folder; gives what every worker holds of it, whose
    size has a bound: slots, leaders and the names of files."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    slots = [r[0] for r in sections.select(F.explode(F.transform("words", lambda w: w.bitwiseAND(SLOTS - 1))).alias("s")).distinct().collect()]  # SLOTS at most
    if not slots:
        return None
    place = np.full(SLOTS, -1, np.int64)
    place[np.sort(slots)] = np.arange(len(slots))
    shared_place = sc.broadcast(place)
    df, total = _document_frequency(docs, shared_place, len(slots))
    idf = np.log((total + 1) / (df + 1)) + 1.0

    def number(frames):
        for pdf in frames:
            yield pd.DataFrame({"ids": pd.Series([_placed(shared_place.value, np.asarray(w, np.int64)).tolist() for w in pdf["words"]], dtype=object)})

    numbered = materialise(sections.select("words").mapInPandas(number, "ids array<bigint>"))
    space = (randomised_svd(numbered, idf, rank) * idf[:, None]).astype(np.float32)
    shared_space = sc.broadcast(space)

    def vectors_of(words) -> tuple[int, np.ndarray]:
        ids = _placed(shared_place.value, np.asarray(words, np.int64))
        return (w := min(RUN, len(ids))), unit_windows(shared_space.value, ids, w)

    passages = sections.agg(F.coalesce(F.sum(F.greatest(F.size("words") - RUN + 1, F.lit(1))), F.lit(0))).first()[0]
    share = int(min(1.0, LEADER_SAMPLE / max(1, passages)) * (1 << 32))

    def sample(batch_iter):
        schema = pa.schema([("width", pa.int32()), ("v", pa.binary())])

        def rows():
            for batch in batch_iter:
                for file, pos, words in zip(*(c.to_pylist() for c in batch.columns)):
                    w, vs = vectors_of(words)
                    for k, v in enumerate(vs):
                        if xxhash.xxh32_intdigest(f"{file}:{pos}:{k}") < share:
                            yield w, v.tobytes()

        yield from batches(rows(), schema)

    own = sections.select("file", "pos", "words")
    drawn: dict[int, list] = {r["width"]: [] for r in sections.select(F.least(F.size("words"), F.lit(RUN)).alias("width")).distinct().collect()}  # RUN rows at most
    for r in own.mapInArrow(sample, "width int, v binary").orderBy("width", "v").collect():  # about LEADER_SAMPLE rows
        drawn[r["width"]].append(np.frombuffer(r["v"], np.float32))
    axis = np.eye(1, space.shape[1], dtype=np.float32)
    leaders = {w: choose_leaders(np.stack(v)) if v else axis for w, v in drawn.items()}
    shared_leaders = sc.broadcast(leaders)

    def assign(batch_iter):
        def rows():
            for batch in batch_iter:
                for file, pos, words in zip(*(c.to_pylist() for c in batch.columns)):
                    w, vs = vectors_of(words)
                    for k, (cell, angle, v) in enumerate(zip(*(x.tolist() for x in nearest_leader(vs, shared_leaders.value[w])), vs)):
                        yield w, cell, angle, xxhash.xxh32_intdigest(f"{file}:{pos}:{k}"), file, pos, v.tobytes()

        yield from batches(rows(), _PASSAGE, 5000)

    assigned = materialise(own.mapInArrow(assign, _PASSAGE_SQL))
    # Cells go to files in the order of their leaders; a large cell is spread over files of its own.
    sizes = assigned.groupBy("width", "leader").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).orderBy("width", "leader").collect()  # a row a leader
    plan, filled, g = [], 0, 0
    held = {w: [np.zeros(len(v), np.float32), [(-1, [])] * len(v)] for w, v in leaders.items()}
    for cell, r in enumerate(sizes):
        parts = -(-r["n"] // FILE_ROWS)
        if filled and filled + r["n"] > FILE_ROWS:
            filled, g = 0, g + 1
        plan += [(r["width"], r["leader"], cell, parts, p, g + p) for p in range(parts)]
        held[r["width"]][0][r["leader"]] = r["radius"]
        held[r["width"]][1][r["leader"]] = (cell, list(range(g, g + parts)))
        g, filled = (g + parts, 0) if parts > 1 else (g, filled + r["n"])
    folder = f"{shared_dir(spark)}/loamstone-index-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    grid = spark.createDataFrame(plan, "width int, leader bigint, cell bigint, parts bigint, p bigint, g bigint")
    numbers = assigned.join(grid.filter("p = 0").select("width", "leader", "cell", "parts"), ["width", "leader"]).withColumn("p", F.pmod("part", "parts"))
    numbers.join(grid.select("cell", "p", "g"), ["cell", "p"]).select("g", "cell", "file", "pos", "v").repartition("g").write.partitionBy("g").parquet(f"{folder}/passages")
    sections.repartition("file").write.partitionBy("file").parquet(f"{folder}/sections")
    # Cells without passages are near nothing.
    for w in held:
        used = np.array([c[0] >= 0 for c in held[w][1]])
        held[w] = (leaders[w][used], held[w][0][used], [c for c in held[w][1] if c[0] >= 0])
    return {"place": place, "idf": idf, "space": space, "unknown": float(idf.max()), "leaders": held, "folder": folder}


def find_leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE, lcs_share: float = LCS_SHARE, rank: int = RANK) -> DataFrame:
    """(item_id, doc_id, kind, cosine, longest_run, lcs, lcs_share, has_answer) for every document that
    repeats 13 tokens of an item or more in a row (``exact``), or whose tokens near one window hold
    ``lcs_share`` of the item in order, and its answer if it has one (``paraphrase``). Every window over
    ``cosine`` is looked at; ``lcs`` is the most near any of them (of a paraphrase: with the answer).

    Two passes over the documents whatever the number of items: one counts terms, one searches. Items lie in
    files of the shared folder, of which a worker holds a few at a time; what is broadcast has a bound. Items
    under 13 tokens are searched whole and can only be paraphrases. Null texts, texts without tokens and
    rows without an id give nothing; repeated rows count once.
    """
    docs = one_row_per_key(docs.select("doc_id", "text"), "doc_id").filter("text is not null")
    items = one_row_per_key(items.select("item_id", "text", "answer"), "item_id").filter("text is not null")
    cut = materialise(_sections(items))
    files = max(1, math.ceil((cut.agg(F.sum(F.size("words"))).first()[0] or 0) / FILE_TOKENS))
    cut = cut.withColumn("file", F.pmod(F.xxhash64("item_id", "section"), F.lit(files)))
    sections = materialise(cut.withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("item_id", "section")).cast("bigint")))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("cosine", pa.float64()), ("longest_run", pa.int64()), ("lcs", pa.int64()), ("lcs_share", pa.float64()), ("has_answer", pa.bool_()), ("asks", pa.bool_())])
    sql = "item_id bigint, doc_id bigint, cosine double, longest_run bigint, lcs bigint, lcs_share double, has_answer boolean, asks boolean"
    index = _build_index(sections, docs, rank)
    if index is None:
        found = docs.sparkSession.createDataFrame([], sql)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def search(batch_iter):
            searcher, hashes = _Searcher(shared.value), Hasher()

            def rows():
                for batch in batch_iter:
                    ids, texts = (c.to_pylist() for c in batch.columns)
                    for at in range(0, len(ids), 256):
                        tokens = [hashes(t) for t in texts[at : at + 256]]
                        for n, hits in searcher.found(tokens, cosine):
                            for section, windows in hits.items():
                                checked = searcher.check(tokens[n], section, windows, lcs_share)
                                if checked:
                                    item_id, _, answer = searcher.sections[section[0]][section[1]]
                                    yield item_id, ids[at + n], *checked, bool(len(answer))

            yield from batches(rows(), schema, 1000)

        found = docs.mapInArrow(search, sql)
    best = found.groupBy("item_id", "doc_id").agg(*[F.max(c).alias(c) for c in ("cosine", "longest_run", "lcs", "lcs_share", "has_answer", "asks")])
    kind = F.when(F.col("longest_run") >= RUN, "exact").when((F.col("lcs_share") >= lcs_share) & (F.col("has_answer") | ~F.col("asks")), "paraphrase")
    return best.withColumn("kind", kind).filter("kind is not null").select("item_id", "doc_id", "kind", "cosine", "longest_run", "lcs", "lcs_share", "has_answer")
