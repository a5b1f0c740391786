"""Sentence boundaries across languages and scripts.

Every final mark is a candidate boundary. Which candidates end a sentence is decided by a
maximum-entropy (logistic) model over features of the neighbouring tokens, their case, length, digits
and script, the mark and its quotes. The model needs no annotation: a mark before an empty line, the
end of the text or, in turns, the end of a line is a reliable boundary, and a left neighbour that is
hardly ever found there although it is frequent is a reliable non-boundary. Two corpus statistics feed
it, counted over all documents: how often a left neighbour closes a paragraph, and how often a right
neighbour opens one. Every neighbour's counts are used: workers hold those of the most frequent ones,
the others are joined to the documents that use them.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.tokens import batches
from loamstone.session import materialise, one_row_per_key

#: Labelled candidates the model is fitted on; those with the smallest hashes are taken.
TRAIN_ROWS = 40_000
#: Characters beside a mark that are looked at first; a longer token is read on to its end.
_REACH = 48
#: Rows of a side's table that workers hold, whatever the corpus; which ones does not change the result.
HELD_KEYS = 100_000

# Final marks, quotes that may follow or open, and scripts without spaces.
MARKS = ".!?。！？।؟…"
CLOSERS = "\"'”’»」』）)\\]“"
OPENERS = "\"'“‘«„「『（(\\[¿¡"
_QUOTE_OPEN, _QUOTE_CLOSE = "“«„「『", "”»」』"
_QUOTES = re.compile(f'["{_QUOTE_OPEN}{_QUOTE_CLOSE}]')
_THAI = "฀-๿"
_CJK = "぀-ヿ㐀-鿿０-９"

_CANDIDATE = re.compile(f"[{MARKS}]+[{CLOSERS}]*")
_SPACE = re.compile(r"\s+")
_LINE_ENDS = re.compile(r"\n+")
_PARAGRAPH = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_LEFT = re.compile(rf"[^\s{OPENERS}{CLOSERS},;:，、；：]+$")
_RIGHT = re.compile(rf"[{OPENERS}]*([^\s{OPENERS}{CLOSERS},;:.!?。！？।؟…，、；：]*)")
_IS_CJK = re.compile(f"[{_CJK}]")
_THAI_SPACE = re.compile(rf"(?:(?<=[{_THAI}])|(?<=[{_THAI}][?!.])|(?<=[{_THAI}][{CLOSERS}]))\s+(?=[{_THAI}A-Za-z0-9{OPENERS}])|(?<=\S)\s+(?=[{_THAI}])")
_HAS_THAI = re.compile(f"[{_THAI}]")
_MID_WORD = re.compile(rf"(?<=[^\s{MARKS}{CLOSERS}])\s+([^\s{OPENERS}{CLOSERS},;:{MARKS}，、；：]+)|[，、]([{_CJK}]{{2}})")
_DIGITS = re.compile(r"\d+")


def blocks(text: str, by_line: bool) -> list[tuple[int, int]]:
    """Spans between empty lines, and in turns between line ends."""
    spans, at = [], 0
    for m in (_LINE_ENDS if by_line else _PARAGRAPH).finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(text)))
    return [s for s in spans if text[s[0] : s[1]].strip()]


def left_key(text: str, start: int, end: int, floor: int) -> tuple[str, str]:
    """(word before the mark, key): the key joins its lower-case form, the mark and closing quotes."""
    reach = _REACH
    while True:
        low = max(floor, start - reach)
        m = _LEFT.search(text[low:start].rstrip())
        if low == floor or (m and m.start()):  # else the word may begin further left
            break
        reach *= 4
    word = m.group() if m else ""
    if word and _IS_CJK.match(word[-1]):
        word = word[-2:]
    marks = text[start:end]
    mark = marks.rstrip("\"'”’»」』）)]“")
    tail = marks[len(mark) :]
    short = "…" if len(mark) > 1 and set(mark) <= set(".…") else mark[:1]
    return word, f"{_DIGITS.sub('#', word.lower())} {short}{tail}"


def right_key(text: str, at: int, ceiling: int) -> str:
    """The next token in lower case (two characters of a script without spaces)."""
    m, reach = _RIGHT.match(text, at, min(ceiling, at + _REACH)), _REACH
    while m and m.end() == at + reach < ceiling:
        reach *= 4
        m = _RIGHT.match(text, at, min(ceiling, at + reach))
    word = m.group(1) if m else ""
    if word and _IS_CJK.match(word[0]):
        word = word[:2]
    return _DIGITS.sub("#", word.lower())


def candidates(text: str, block: tuple[int, int]):
    """(mark start, end with quotes, start of the next token, inside a quotation) for the marks of a block."""
    floor, ceiling = block
    depth, low, straight, at = 0, 0, False, floor
    for m in _CANDIDATE.finditer(text, floor, ceiling):
        a, b = m.span()
        for q in _QUOTES.finditer(text, at, a):
            c = q.group()
            if c == '"':
                straight = not straight
            elif c == "“" and low:  # closes a quotation that „ opened
                depth, low = max(0, depth - 1), low - 1
            elif c in _QUOTE_OPEN:
                depth, low = depth + 1, low + (c == "„")
            elif c in _QUOTE_CLOSE:
                depth = max(0, depth - 1)
        mark_end = a
        while mark_end < b and text[mark_end] in MARKS:
            mark_end += 1
        tail = text[mark_end:b]
        if '"' in tail and not straight and tail.index('"') == 0 and b < ceiling and not text[b].isspace():
            b, tail = mark_end, ""  # an opening quote, not a closing one
        for c in tail:
            if c == '"':
                straight = not straight
            elif c == "“" and low:
                depth, low = max(0, depth - 1), low - 1
            elif c in _QUOTE_CLOSE:
                depth = max(0, depth - 1)
        at = b
        quoted = depth > 0 or straight
        gap = _SPACE.match(text, b, ceiling)
        follows = gap.end() if gap else b
        if not gap and b < ceiling:
            wide = text[a] in "。！？।؟" or _IS_CJK.match(text[b]) or (a > floor and _IS_CJK.match(text[a - 1]) and text[a] == "…")
            if not wide:
                continue
        yield a, b, follows, quoted


def _first(text: str, block: tuple[int, int]) -> int:
    """Where the first token of a block starts."""
    return block[1] - len(text[block[0] : block[1]].lstrip())


def used_keys(text: str, by_line: bool) -> set[tuple[str, str]]:
    """(side, key) of every count that the features of a text's candidates look up."""
    used = set()
    for block in blocks(text, by_line):
        used.add(("R", right_key(text, _first(text, block), block[1])))
        for a, b, follows, _ in candidates(text, block):
            word, key = left_key(text, a, b, block[0])
            used |= {("L", key), ("R", _DIGITS.sub("#", word.lower())), ("R", right_key(text, follows, block[1]))}
    return used


def _statistics(batch_iter):
    """Counts of neighbours: (side, key, at an edge, within)."""
    schema = pa.schema([("side", pa.string()), ("key", pa.string()), ("edge", pa.int64()), ("inner", pa.int64())])
    edge, inner, words = Counter(), Counter(), Counter()

    def flush():
        for (word, pair), n in words.items():
            inner["R", _DIGITS.sub("#", ((word[:2] if _IS_CJK.match(word[0]) else word) if word else pair).lower())] += n
        words.clear()
        for side, key in {*edge, *inner}:
            yield side, key, edge[(side, key)], inner[(side, key)]
        edge.clear()
        inner.clear()

    def rows():
        for batch in batch_iter:
            for _, text, by_line in zip(*(c.to_pylist() for c in batch.columns)):
                for block in blocks(text, by_line):
                    edge["R", right_key(text, _first(text, block), block[1])] += 1
                    words.update(_MID_WORD.findall(text, *block))
                    for a, b, follows, _ in candidates(text, block):
                        _, key = left_key(text, a, b, block[0])
                        (edge if follows >= block[1] else inner)["L", key] += 1
            if len(edge) + len(inner) + len(words) > 200_000:
                yield from flush()
        yield from flush()

    yield from batches(rows(), schema)


class Model:
    """Neighbour statistics and weights; small enough to go to every worker. ``rest``, which stays with
    the driver, has the statistics (side, key, edge, inner) of the neighbours that are not held."""

    def __init__(self, left: dict, right: dict, rate: float, start_rate: float, weights: np.ndarray | None = None, rest: DataFrame | None = None):
        self.left, self.right, self.rate, self.start_rate, self.weights, self.rest = left, right, rate, start_rate, weights, rest

    def __getstate__(self) -> dict:
        return {**self.__dict__, "rest": None}

    def knowing(self, rare: list | None) -> Model:
        """The model with the statistics ``rare`` of further neighbours."""
        if not rare:
            return self
        more: dict[str, dict] = {"L": {}, "R": {}}
        for r in rare:
            more[r["side"]][r["key"]] = (r["edge"], r["inner"])
        return Model(ChainMap(more["L"], self.left), ChainMap(more["R"], self.right), self.rate, self.start_rate, self.weights)

    def reliable_inner(self, word: str, key: str, quoted: bool) -> bool:
        """A left neighbour so rarely at an edge that its marks end nothing."""
        e, i = self.left.get(key, (0, 0))
        if e + 3.0 * math.sqrt(e + 1.0) >= 0.35 * self.rate * (e + i):
            return False
        return quoted or not key.endswith(" .") or len(word) <= 3 or self.dotted(word, e + i) > 0.8

    def dotted(self, word: str, seen: int) -> float:
        """Share of a word's occurrences inside sentences that have the mark: near 1 for abbreviations, 0 if
        nothing is known of the word."""
        inner = self.right.get(_DIGITS.sub("#", word.lower()), (0, 0))[1]
        return min(1.0, seen / max(seen, inner)) if inner else 0.0

    def features(self, text: str, block: tuple[int, int], a: int, b: int, follows: int, quoted: bool) -> list[float]:
        word, key = left_key(text, a, b, block[0])
        e, i = self.left.get(key, (0, 0))
        seen = e + i
        ratio = math.log((e + 1.5) / (seen * self.rate + 1.5))
        missed = math.log1p(max(0.0, seen * self.rate - 4.0)) if not e else 0.0
        nxt = right_key(text, follows, block[1])
        s, r = self.right.get(nxt, (0, 0))
        opens = math.log((s + 0.3) / ((s + r) * self.start_rate + 0.3)) if s + r else 0.0
        c = text[follows] if follows < block[1] else ""
        letter = next((x for x in text[follows : min(block[1], follows + 3)] if x.isalnum()), "")
        closer = b > a and text[b - 1] not in MARKS
        mark = text[a]
        many = b - a > 1 and text[a + 1] in ".…" or mark == "…"
        lower = letter.islower()
        return [
            1.0,
            max(-4.0, min(4.0, ratio)),
            missed,
            missed * (self.dotted(word, seen) > 0.8 or quoted or closer or many),
            1.0 if not seen else 0.0,
            max(-4.0, min(4.0, opens)),
            1.0 if not s + r else 0.0,
            float(letter.isupper()),
            float(lower),
            float(letter.isdigit()),
            float(bool(c) and c in "\"'“‘«„「『¿¡"),
            float(mark == "." and not many),
            float(many),
            float(mark in "!?！？؟"),
            float(mark in "。।"),
            float(closer),
            float(closer and lower),
            float(quoted),
            float("." in word),
            float(len(word) == 1),
            float(len(word) <= 3),
            float(bool(word) and word[-1].isdigit()),
            float(mark == "." and letter.isdigit() and not (word and word[-1].isdigit())),
            float(many and lower),
        ]

    def cut(self, text: str, by_line: bool) -> list[tuple[int, int]]:
        """Sentence spans in code points, white space around them excluded."""
        spans, places, rows = blocks(text, by_line), [], []
        for k, block in enumerate(spans):
            for a, b, follows, quoted in candidates(text, block):
                if follows < block[1]:
                    places.append((k, b))
                    rows.append(self.features(text, block, a, b, follows, quoted))
        ends: list[list[int]] = [[] for _ in spans]
        if rows:
            for (k, b), yes in zip(places, (np.array(rows) @ self.weights > 0.0).tolist()):
                if yes:
                    ends[k].append(b)
        thai = _HAS_THAI.search(text)
        out = []
        for block, own in zip(spans, ends):
            if thai:
                own = sorted({*own, *(m.start() for m in _THAI_SPACE.finditer(text, *block) if m.start() > block[0])})
            at = block[0]
            for end in [*own, block[1]]:
                part = text[at:end]
                bare = part.strip()
                if bare:
                    start = at + len(part) - len(part.lstrip())
                    out.append((start, start + len(bare)))
                at = end
        return out


def _prose(docs: DataFrame, turns: str) -> DataFrame:
    docs = one_row_per_key(docs.select("doc_id", "text", "kind"), "doc_id").filter("text is not null")
    return docs.select("doc_id", "text", F.coalesce(F.col("kind") == turns, F.lit(False)).alias("by_line"))


def _labelled(batch_iter, model, below: tuple[int, int]):
    """(hash, label, features) of candidates with a reliable label whose hash of document and place is below
    that label's bound. Features are computed for those only."""
    schema = pa.schema([("h", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])

    def rows():
        for batch in batch_iter:
            for doc_id, text, by_line, rare in zip(*(c.to_pylist() for c in batch.columns)):
                m = model.value.knowing(rare)
                spans = blocks(text, by_line)
                for k, block in enumerate(spans):
                    for a, b, follows, quoted in candidates(text, block):
                        h = xxhash.xxh64_intdigest(f"{doc_id}:{a}") >> 1
                        if follows >= block[1]:  # the next block is what follows a reliable boundary
                            if k + 1 < len(spans) and h < below[1]:
                                after = spans[k + 1]
                                yield h, 1, m.features(text, (block[0], after[1]), a, b, _first(text, after), quoted)
                        elif h < below[0]:
                            word, key = left_key(text, a, b, block[0])
                            if quoted or m.reliable_inner(word, key, quoted):
                                yield h, 0, m.features(text, block, a, b, follows, quoted)

    yield from batches(rows(), schema, 2000)


def _sampled(prose: DataFrame, model: Model, half: int) -> tuple[DataFrame, tuple[int, int]]:
    """Documents and bounds of hashes among which about twice ``half`` candidates of each label are to be
    found, however large the corpus: documents are chosen by their hash, then candidates by theirs."""
    inner = sum(i for key, (e, i) in model.left.items() if model.reliable_inner(key.rpartition(" ")[0], key, False))
    edge = sum(e for e, _ in model.left.values())
    shares = [min(1.0, 2.0 * half / max(1, n)) for n in (inner, edge)]
    of_docs = max(shares)
    chosen = prose if of_docs == 1.0 else prose.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(of_docs * (1 << 30)))
    return chosen, tuple(min(1 << 63, int(s / of_docs * (1 << 63))) for s in shares)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a penalised logistic (maximum-entropy) model by Newton steps; both labels weigh alike."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    each = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (each * (p - y)) + penalty * w
        hess = (x * (each * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _with_rare(prose: DataFrame, model: Model) -> DataFrame:
    """``prose`` and the column ``rare``: statistics of the neighbours in a text that the model does not hold."""
    if model.rest is None:
        return prose.withColumn("rare", F.lit(None).cast("array<struct<side:string,key:string,edge:bigint,inner:bigint>>"))
    schema = pa.schema([("doc_id", pa.int64()), ("side", pa.string()), ("key", pa.string())])
    shared = prose.sparkSession.sparkContext.broadcast(model)

    def unheld(batch_iter):
        def rows():
            held = {"L": shared.value.left, "R": shared.value.right}
            for batch in batch_iter:
                for doc_id, text, by_line in zip(*(c.to_pylist() for c in batch.columns)):
                    for side, key in used_keys(text, by_line):
                        if key not in held[side]:
                            yield doc_id, side, key

        yield from batches(rows(), schema)

    pairs = prose.mapInArrow(unheld, "doc_id bigint, side string, key string").join(model.rest, ["side", "key"])
    rare = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("side", "key", "edge", "inner")).alias("rare"))  # the keys of one text
    return prose.join(materialise(rare), "doc_id", "left").select("doc_id", "text", "by_line", "rare")


def train(prose: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Statistics over all of ``prose`` (doc_id, text, by_line) and the model fitted on at most
    ``train_rows`` reliably labelled candidates, half of each label, chosen by hash; about twice as many are
    written, whatever the corpus."""
    counted = prose.mapInArrow(_statistics, "side string, key string, edge bigint, inner bigint")
    summed = materialise(counted.groupBy("side", "key").agg(F.sum("edge").alias("edge"), F.sum("inner").alias("inner")))
    tables: dict[str, dict] = {}
    rates, rest = {}, None
    seen = F.col("edge") + F.col("inner")
    for side in ("L", "R"):
        own = summed.filter(F.col("side") == side)
        e, i, n = own.agg(F.coalesce(F.sum("edge"), F.lit(0)), F.coalesce(F.sum("inner"), F.lit(0)), F.count(F.lit(1))).first()
        rates[side] = e / max(1, e + i)
        held = own.orderBy(seen.desc(), "key").limit(HELD_KEYS).collect()
        tables[side] = {r["key"]: (r["edge"], r["inner"]) for r in held}
        if n > len(held):
            least, last = held[-1]["edge"] + held[-1]["inner"], held[-1]["key"]
            more = own.filter((seen < least) | (seen == least) & (F.col("key") > last))
            rest = more if rest is None else rest.union(more)
    model = Model(tables["L"], tables["R"], rates["L"], rates["R"], rest=rest)
    shared = prose.sparkSession.sparkContext.broadcast(model)
    half = train_rows // 2
    chosen, below = _sampled(prose, model, half)
    rows = materialise(_with_rare(chosen, model).mapInArrow(lambda it: _labelled(it, shared, below), "h bigint, label int, x array<double>"))
    sample = [r for y in (0, 1) for r in rows.filter(F.col("label") == y).orderBy("h").limit(half).collect()]
    if sample:
        x, y = np.array([r["x"] for r in sample]), np.array([r["label"] for r in sample], float)
        model.weights = fit_logistic(x, y)
    else:
        model.weights = np.eye(1, 24)[0]
    return model


def split_sentences(docs: DataFrame, model: Model | None = None, turns: str = "turn", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, s_start, s_end) of every sentence, in code points.

    ``docs`` needs ``doc_id``, ``text`` and ``kind``; in documents of kind ``turns`` a line end ends a
    sentence. A text without marks is one sentence a paragraph. Null and blank texts and rows without a
    document give nothing; a repeated document counts once. Without a fitted ``model`` one is trained on
    these documents. Texts are cut where they are read and only neighbour counts are shuffled, unless there
    are more than ``HELD_KEYS`` neighbours: then texts are joined with the counts of their rare ones.
    """
    prose = _prose(docs, turns)
    model = model or train(prose, train_rows)
    shared = prose.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("s_start", pa.int64()), ("s_end", pa.int64())])

    def cut(batch_iter):
        def rows():
            for batch in batch_iter:
                for doc_id, text, by_line, rare in zip(*(c.to_pylist() for c in batch.columns)):
                    for start, end in shared.value.knowing(rare).cut(text, by_line):
                        yield doc_id, start, end

        yield from batches(rows(), schema)

    return _with_rare(prose, model).mapInArrow(cut, "doc_id bigint, s_start bigint, s_end bigint")
