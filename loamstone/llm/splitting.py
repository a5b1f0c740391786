"""Splitting oversized texts at natural boundaries, by ranges.

A text is a row of tokens; the gap before each token has a *level* (how natural a cut there is) and a
place where it is cut. Pieces are laid greedily: each ends at the best boundary within the limit and the
next begins ``overlap`` tokens before that end. So that a giant text can be cut in parallel, a text of
more than ``FIXED_AFTER`` limits of tokens has *fixed cuts*: the best boundary of the half limit before
every such number of tokens. They are a matter of token numbers alone; however a text is cut into ranges,
and whether it is at all, its pieces are the same.

Workers scan ranges of a fixed number of characters (or bytes of a file), each with a halo: the gap that
runs into it from the left. The first pass writes a row a range, the *boundary table*: how many tokens
begin in it, how word runs and unbroken stretches enter and leave it. Prefix sums over that table give
every range the tokens, characters and bytes before it and the phase of the word run that crosses its left
edge. The second pass lists every range's boundaries by global token number, the lists between two fixed
cuts are stitched, and pieces are emitted by offset. No step holds more of a text than a range and the gap
before it, or the boundaries between two fixed cuts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamstone.llm.tokens import SINGLE_CHARS, TOKEN_MAX, WORD_CHARS, batches
from loamstone.session import materialise, one_row_per_key

# Characters that end a stretch (white space and sentence marks), marks that end a sentence
# without a space after them, clause marks, and characters that may stand between a mark and its space.
SPACES = "\\u0000-\\u0020\\u00A0\\u3000"
MARKS = ".!?。！？।؟…"
_WIDE_MARKS = "。！？।؟"
_CLAUSES = ",;:，、；：،؛)）"
_CLOSERS = "\"'”’»」』）)\\]"

#: Boundary levels, the larger the better.
HARD, SPACE, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)

#: Limits of tokens after which a text has a fixed cut.
FIXED_AFTER = 64
DEFAULT_RANGE = 1 << 20
#: Characters of short texts that are scanned at once.
_GROUP = 500_000

_WORD_F, _SINGLE_F, _SPACE_F, _NEWLINE_F, _MARK_F, _WIDE_F, _CLAUSE_F, _CLOSER_F = (np.uint8(1 << i) for i in range(8))


def _flag_table() -> np.ndarray:
    """What each character is; the last entry stands for all beyond the basic plane."""
    table = np.zeros(0x10001, np.uint8)
    plane = "".join(map(chr, range(0x10000)))
    for flag, chars in ((_WORD_F, WORD_CHARS), (_SINGLE_F, SINGLE_CHARS), (_SPACE_F, SPACES), (_NEWLINE_F, "\n"), (_MARK_F, MARKS), (_WIDE_F, _WIDE_MARKS), (_CLAUSE_F, _CLAUSES), (_CLOSER_F, _CLOSERS)):
        for m in re.finditer(f"[{chars}]+", plane):
            table[m.start() : m.end()] |= flag
    return table


_FLAGS = _flag_table()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def flags_of(points: np.ndarray) -> np.ndarray:
    return _FLAGS[np.minimum(points, 0x10000)]


def _last(where: np.ndarray) -> np.ndarray:
    """For every place the last one up to it where the condition holds, -1 before the first."""
    return np.maximum.accumulate(np.where(where, np.arange(len(where)), -1))


@dataclass
class Boundaries:
    """Tokens of a stretch of text: where each begins, where a cut before it is made, and its level."""

    starts: np.ndarray
    cuts: np.ndarray
    levels: np.ndarray


def token_starts(f: np.ndarray, carry: int = 0) -> np.ndarray:
    """Where tokens begin; ``carry`` characters of the word run at the left edge stand before it."""
    word = (f & _WORD_F) > 0
    outside = _last(~word)
    place = np.arange(len(f)) - outside - 1
    if carry:
        place[outside < 0] += carry
    return np.flatnonzero(((f & _SINGLE_F) > 0) | (word & (place % TOKEN_MAX == 0)))


def boundaries(f: np.ndarray, carry: int = 0) -> Boundaries:
    starts = token_starts(f, carry)
    if not len(starts):
        return Boundaries(starts, starts, np.zeros(0, np.uint8))
    space, newline = (f & _SPACE_F) > 0, (f & _NEWLINE_F) > 0
    level = ((f & (_SPACE_F | _MARK_F)) > 0).astype(np.uint8)
    level[(f & _CLAUSE_F) > 0] = CLAUSE
    at = np.flatnonzero(space)
    at = at[at > 0]
    before = _last((f & _CLOSER_F) == 0)[at - 1]  # what closing quotes follow
    level[at[(before >= 0) & ((f[before] & _MARK_F) > 0)]] = SENTENCE
    level[(f & _WIDE_F) > 0] = SENTENCE
    at = np.flatnonzero(newline)
    level[at] = LINE
    at = at[at > 0]
    before = _last(~space | newline)[at - 1]
    level[at[(before >= 0) & newline[before]]] = PARAGRAPH

    left = np.maximum(starts - 1, 0)
    gap = _last((f & (_WORD_F | _SINGLE_F)) > 0)[left] + 1
    gap[starts == 0] = 0
    edges = np.stack([gap, starts], axis=1).ravel()
    levels = np.maximum.reduceat(level, edges)[::2]
    levels[gap == starts] = HARD
    last_space, last_mark = _last(space)[left], _last((f & (_MARK_F | _CLAUSE_F)) > 0)[left]
    cuts = np.where(last_space >= gap, last_space + 1, np.where(last_mark >= gap, last_mark + 1, starts))
    cuts[gap == starts] = starts[gap == starts]
    return Boundaries(starts, cuts, levels)


def stretches(f: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the stretch of each token, tokens of each stretch): stretches have no white space and no mark."""
    ends = np.cumsum((f & (_SPACE_F | _MARK_F)) > 0)
    own = ends[starts]
    return own, np.bincount(own, minlength=int(ends[-1]) + 1 if len(ends) else 1)


def fixed_every(limit: int) -> int:
    return FIXED_AFTER * max(1, limit)


def fixed_cut(levels: np.ndarray, first: int, number: int, limit: int) -> int:
    """The fixed cut at token ``number``: the best boundary of the half limit up to it, the later one on
    ties. ``levels`` begin at token ``first``."""
    low = number - max(1, limit // 2) + 1
    window = levels[low - first : number + 1 - first]
    return number - int(np.argmax(window[::-1]))


def lay_pieces(levels: np.ndarray, first: int, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, end token) of the pieces of tokens ``begin`` to ``end``; ``levels`` begin at token
    ``first``. A piece ends at the most natural boundary of its second half, or of its first if the second
    has none, the later one on ties, and the next begins ``overlap`` tokens before that end."""
    if end - begin <= limit:
        return [(begin, end)]
    last = [_last(levels >= k) for k in range(SPACE, PARAGRAPH + 1)][::-1]
    pieces, a = [], begin - first
    stop = end - first
    while stop - a > limit:
        middle = a + max(overlap, limit // 2) - 1
        b = a + limit
        for high, low in ((b, max(a + overlap, middle)), (middle, a + overlap)):
            found = next((x for x in (int(k[max(0, high)]) for k in last) if x > low), None)
            if found is not None:
                b = found
                break
        pieces.append((first + a, first + b))
        a = b - overlap
    pieces.append((first + a, end))
    return pieces


def piece_tokens(levels: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, end token) of the pieces of a whole text of one token or more."""
    n, every = len(levels), fixed_every(limit)
    cuts = [0, *(fixed_cut(levels, 0, k, limit) for k in range(every, n, every)), n]
    begins = [max(0, c - overlap) for c in cuts]
    return [p for a, b in zip(begins, cuts[1:]) for p in lay_pieces(levels[a : b + 1], a, a, b, limit, overlap)]


_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("token_start", pa.int64()), ("token_count", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("cut_level", pa.int32()), ("piece_text", pa.string()), ("chunk_size", pa.int32()), ("overlap", pa.int32()), ("doc_tokens", pa.int64()), ("longest_stretch", pa.int64())]
)
_PIECES_SQL = "doc_id bigint, token_start bigint, token_count bigint, char_start bigint, char_end bigint, cut_level int, piece_text string, chunk_size int, overlap int, doc_tokens bigint, longest_stretch bigint"


def _scan_group(rows: list[tuple], oversized_only: bool, texts: bool):
    """Pieces of short texts, scanned as one with a line end after each."""
    f = flags_of(code_points("\n".join([*(r[1] for r in rows), ""])))
    found = boundaries(f)
    own, counts = stretches(f, found.starts)
    edges = np.cumsum([0, *(len(r[1]) + 1 for r in rows)])
    tokens = np.searchsorted(found.starts, edges)
    for k, (doc_id, text, size, overlap) in enumerate(rows):
        a, b, base = int(tokens[k]), int(tokens[k + 1]), int(edges[k])
        n = b - a
        if oversized_only and n <= size:
            continue
        longest = int(counts[own[a] : own[b - 1] + 1].max()) if n else 0
        if n <= size:
            yield doc_id, 0, n, 0, len(text), PARAGRAPH, text if texts else None, size, overlap, n, longest
            continue
        levels, cuts = found.levels[a:b], (found.cuts[a:b] - base).tolist()
        cuts[0] = 0
        for i, j in piece_tokens(levels, size, overlap):
            c, d, level = cuts[i], len(text) if j == n else cuts[j], PARAGRAPH if j == n else int(levels[j])
            yield doc_id, i, j - i, c, d, level, text[c:d] if texts else None, size, overlap, n, longest


def _short_pieces(batch_iter, oversized_only: bool, texts: bool):
    def rows():
        for batch in batch_iter:
            group, chars = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                group.append(row)
                chars += len(row[1])
                if chars > _GROUP:
                    yield from _scan_group(group, oversized_only, texts)
                    group, chars = [], 0
            if group:
                yield from _scan_group(group, oversized_only, texts)

    yield from batches(rows(), _PIECES, 2000)


# -- ranges ----------------------------------------------------------------------------------------

_SCAN = pa.schema([(n, pa.int64()) for n in ("doc_id", "r", "chars", "nbytes", "lead", "trail", "inner_tokens", "lead_stretch", "trail_stretch", "most")] + [("broken", pa.bool_()), ("chunk_size", pa.int32()), ("overlap", pa.int32())])
_SCAN_SQL = "doc_id bigint, r bigint, chars bigint, nbytes bigint, lead bigint, trail bigint, inner_tokens bigint, lead_stretch bigint, trail_stretch bigint, most bigint, broken boolean, chunk_size int, overlap int"


def _utf8_lengths(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def scan_range(body: str) -> tuple:
    """A range's row of the boundary table: characters, bytes, word characters at its start and end (their
    runs may reach over the edges), tokens after the run at the start, and of stretches the tokens of the
    first (without that run), of the last and the most of any between; whether a stretch ends in it."""
    points = code_points(body)
    f = flags_of(points)
    outside = np.flatnonzero((f & _WORD_F) == 0)
    lead = int(outside[0]) if len(outside) else len(f)
    trail = len(f) - 1 - int(outside[-1]) if len(outside) else len(f)
    rest = f[lead:]
    starts = token_starts(rest)
    _, counts = stretches(rest, starts)
    return len(f), int(_utf8_lengths(points).sum()), lead, trail, len(starts), int(counts[0]), int(counts[-1]), int(counts[1:-1].max(initial=0)), len(counts) > 1


def stitch(scans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The boundary table with prefix sums: for every range the characters, bytes and tokens before
    it, the characters of the word run that enters it, and the text's totals. One small row a range."""
    w = W.partitionBy(key).orderBy("r")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    whole = F.col("lead") == F.col("chars")
    reset = F.last(F.when(~whole, F.col("end_chars") - F.col("trail")), ignorenulls=True).over(before)
    df = scans.withColumn("end_chars", F.sum("chars").over(w)).withColumn("char_base", F.col("end_chars") - F.col("chars"))
    df = df.withColumn("carry", F.col("char_base") - F.coalesce(reset, F.lit(0)))
    lead = F.floor((F.col("carry") + F.col("lead") + (TOKEN_MAX - 1)) / TOKEN_MAX) - F.floor((F.col("carry") + (TOKEN_MAX - 1)) / TOKEN_MAX)
    df = df.withColumn("lead_tokens", lead.cast("bigint")).withColumn("tokens", F.col("lead_tokens") + F.col("inner_tokens"))
    df = df.withColumn("end_tokens", F.sum("tokens").over(w)).withColumn("token_base", F.col("end_tokens") - F.col("tokens"))
    df = df.withColumn("byte_base", F.sum("nbytes").over(w) - F.col("nbytes"))
    # Stretches that cross edges: tokens since the last break before the range, plus its leading stretch.
    since = F.last(F.when(F.col("broken"), F.col("end_tokens") - F.col("trail_stretch")), ignorenulls=True).over(before)
    df = df.withColumn("entering", F.col("token_base") - F.coalesce(since, F.lit(0)))
    df = df.withColumn("crossing", F.col("entering") + F.col("lead_tokens") + F.col("lead_stretch"))
    own = F.greatest("crossing", "most", "trail_stretch")
    every = W.partitionBy(key)
    totals = {"doc_tokens": F.sum("tokens"), "doc_chars": F.sum("chars"), "doc_bytes": F.sum("nbytes"), "longest_stretch": F.max(own)}
    return df.withColumns({n: c.over(every) for n, c in totals.items()}).select(key, "r", "carry", "char_base", "byte_base", "token_base", "chunk_size", "overlap", *totals)


def gap_before(text: str, start: int) -> str:
    """The halo of a range that begins at ``start``: what stands between it and the last token before it."""
    width = 64
    while start:
        part = text[max(0, start - width) : start]
        solid = np.flatnonzero(flags_of(code_points(part)) & (_WORD_F | _SINGLE_F))
        if len(solid):
            return part[int(solid[-1]) + 1 :]
        if width >= start:
            return part
        width *= 2
    return ""


_RANGES = pa.schema([("doc_id", pa.int64()), ("r", pa.int64()), ("halo", pa.string()), ("body", pa.string()), ("chunk_size", pa.int32()), ("overlap", pa.int32())])
_RANGES_SQL = "doc_id bigint, r bigint, halo string, body string, chunk_size int, overlap int"


def _ranges(docs: DataFrame, range_chars: int) -> DataFrame:
    """A row a range of each text, with its halo."""

    def cut(batch_iter):
        def rows():
            for batch in batch_iter:
                for doc_id, text, size, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                    for r, at in enumerate(range(0, max(1, len(text)), range_chars)):
                        yield doc_id, r, gap_before(text, at), text[at : at + range_chars], size, overlap

        yield from batches(rows(), _RANGES, max(1, (8 << 20) // range_chars))

    return docs.mapInArrow(cut, _RANGES_SQL)


def _scan_rows(batch_iter):
    def rows():
        for batch in batch_iter:
            for doc_id, r, body, size, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                yield doc_id, r, *scan_range(body), size, overlap

    yield from batches(rows(), _SCAN)


_SLICE = pa.schema([("doc_id", pa.int64()), ("k", pa.int64()), ("first", pa.int64()), ("cuts", pa.list_(pa.int64())), ("cut_bytes", pa.list_(pa.int64())), ("levels", pa.binary()), ("chunk_size", pa.int32()), ("overlap", pa.int32()), ("doc_tokens", pa.int64()), ("doc_chars", pa.int64()), ("doc_bytes", pa.int64()), ("longest_stretch", pa.int64())])
_SLICE_SQL = "doc_id bigint, k bigint, first bigint, cuts array<bigint>, cut_bytes array<bigint>, levels binary, chunk_size int, overlap int, doc_tokens bigint, doc_chars bigint, doc_bytes bigint, longest_stretch bigint"


def _list_boundaries(batch_iter):
    """A range's boundaries by global token number, to every block between fixed cuts that needs them: block
    k lays pieces from the fixed cut near its first token to that near the next block's."""

    def rows():
        for batch in batch_iter:
            for x in batch.to_pylist():
                points = code_points(x["halo"] + x["body"])
                found = boundaries(flags_of(points), x["carry"])
                n = len(found.starts)
                if not n:
                    continue
                halo = len(x["halo"])
                nbytes = np.concatenate([[0], np.cumsum(_utf8_lengths(points))])
                cuts, cut_bytes = found.cuts - halo + x["char_base"], nbytes[found.cuts] - nbytes[halo] + x["byte_base"]
                base, size = x["token_base"], x["chunk_size"]
                if base == 0:
                    cuts[0] = cut_bytes[0] = 0
                every, reach = fixed_every(size), max(1, size // 2) + x["overlap"]
                totals = (size, x["overlap"], x["doc_tokens"], x["doc_chars"], x["doc_bytes"], x["longest_stretch"])
                for k in range(max(0, -(-base // every) - 1), (base + n - 1 + reach) // every + 1):
                    if k * every >= x["doc_tokens"]:
                        break
                    a, b = max(0, k * every - reach - base), min(n, (k + 1) * every + 1 - base)
                    if a < b:
                        yield (x["doc_id"], k, base + a, cuts[a:b].tolist(), cut_bytes[a:b].tolist(), found.levels[a:b].tobytes(), *totals)

    yield from batches(rows(), _SLICE, 64)


_PLACED = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("token_start", "token_count", "char_start", "char_end", "byte_start", "byte_end")), ("cut_level", pa.int32()), ("chunk_size", pa.int32()), ("overlap", pa.int32()), ("doc_tokens", pa.int64()), ("longest_stretch", pa.int64())])
_PLACED_SQL = "doc_id bigint, token_start bigint, token_count bigint, char_start bigint, char_end bigint, byte_start bigint, byte_end bigint, cut_level int, chunk_size int, overlap int, doc_tokens bigint, longest_stretch bigint"


def _lay_blocks(batch_iter):
    def rows():
        for batch in batch_iter:
            for x in batch.to_pylist():
                slices, size, overlap, n, k = x["slices"], x["chunk_size"], x["overlap"], x["doc_tokens"], x["k"]
                first, every = slices[0]["first"], fixed_every(size)
                levels = np.frombuffer(b"".join(s["levels"] for s in slices), np.uint8)
                cuts = [c for s in slices for c in s["cuts"]]
                cut_bytes = [c for s in slices for c in s["cut_bytes"]]
                begin = fixed_cut(levels, first, k * every, size) - overlap if k else 0
                end = fixed_cut(levels, first, (k + 1) * every, size) if (k + 1) * every < n else n
                for i, j in lay_pieces(levels, first, begin, end, size, overlap):
                    at = (x["doc_chars"], x["doc_bytes"], PARAGRAPH) if j == n else (cuts[j - first], cut_bytes[j - first], int(levels[j - first]))
                    yield x["doc_id"], i, j - i, cuts[i - first], at[0], cut_bytes[i - first], at[1], at[2], size, overlap, n, x["longest_stretch"]

    yield from batches(rows(), _PLACED, 5000)


def _place(ranges: DataFrame) -> DataFrame:
    """Pieces of texts by offset, from their ranges (doc_id, r, halo, body, chunk_size, overlap)."""
    table = materialise(stitch(ranges.select("doc_id", "r", "body", "chunk_size", "overlap").mapInArrow(_scan_rows, _SCAN_SQL)))
    lists = ranges.select("doc_id", "r", "halo", "body").join(table, ["doc_id", "r"]).mapInArrow(_list_boundaries, _SLICE_SQL)
    totals = ["chunk_size", "overlap", "doc_tokens", "doc_chars", "doc_bytes", "longest_stretch"]
    # Slices of one block: their tokens number FIXED_AFTER limits and a little more.
    blocks = lists.groupBy("doc_id", "k", *totals).agg(F.sort_array(F.collect_list(F.struct("first", "cuts", "cut_bytes", "levels"))).alias("slices"))
    placed = blocks.mapInArrow(_lay_blocks, _PLACED_SQL)
    zero = F.lit(0).cast("bigint")
    bare = table.filter("r = 0 and doc_tokens = 0").select("doc_id", zero.alias("token_start"), zero.alias("token_count"), zero.alias("char_start"), F.col("doc_chars").alias("char_end"), zero.alias("byte_start"), F.col("doc_bytes").alias("byte_end"), F.lit(PARAGRAPH).alias("cut_level"), "chunk_size", "overlap", "doc_tokens", "longest_stretch")
    return placed.unionByName(bare)


def _with_texts(placed: DataFrame, docs: DataFrame) -> DataFrame:
    """Placed pieces with their texts: a text meets all its pieces' offsets, which are fewer than its characters."""
    names = [n.split()[0] for n in _PLACED_SQL.split(", ") if n.split()[0] not in ("doc_id", "byte_start", "byte_end")]
    offsets = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("pieces"))

    def cut(batch_iter):
        def rows():
            for batch in batch_iter:
                for doc_id, text, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                    for p in pieces:
                        yield doc_id, p["token_start"], p["token_count"], p["char_start"], p["char_end"], p["cut_level"], text[p["char_start"] : p["char_end"]], p["chunk_size"], p["overlap"], p["doc_tokens"], p["longest_stretch"]

        yield from batches(rows(), _PIECES, 2000)

    return docs.select("doc_id", "text").join(offsets, "doc_id").select("doc_id", "text", "pieces").mapInArrow(cut, _PIECES_SQL)


# -- entry points ----------------------------------------------------------------------------------


def split_documents(docs: DataFrame, size: Column | int, overlap: Column | int, range_chars: int = DEFAULT_RANGE, oversized_only: bool = False, texts: bool = True) -> DataFrame:
    """Pieces of every text that has any, or with ``oversized_only`` of those of more than ``size`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; ``size`` (tokens a piece may have, 1 at least) and
    ``overlap`` are numbers or columns of it; an overlap is kept under the size. Gives ``doc_id,
    token_start, token_count, char_start, char_end`` (code points), ``cut_level`` (0 inside an unbroken
    stretch, 1 space, 2 clause, 3 sentence, 4 line, 5 paragraph or end of text), ``piece_text,
    chunk_size, overlap, doc_tokens, longest_stretch`` (most tokens without white space or a sentence
    mark). Neighbours share ``overlap`` tokens exactly; without overlap the pieces of a text concatenate to
    it. ``piece_text`` is null without ``texts``. Null and empty texts and rows without a document have no pieces; a text without tokens is one piece
    of none; a repeated document is cut once. ``range_chars`` does not change the pieces.

    Texts of one range never leave their task. Longer ones are cut by range: a boundary row a range, each
    range once, and the lists of boundaries are shuffled.
    """
    size = F.lit(size) if isinstance(size, int) else size
    overlap = F.lit(overlap) if isinstance(overlap, int) else overlap
    docs = docs.select("doc_id", "text", F.greatest(size, F.lit(1)).cast("int").alias("chunk_size"), overlap.cast("int").alias("overlap"))
    docs = docs.withColumn("overlap", F.greatest(F.lit(0), F.least("overlap", F.col("chunk_size") - 1))).filter("text is not null and text <> ''")
    docs = one_row_per_key(docs, "doc_id")
    pieces = docs.filter(F.length("text") <= range_chars).mapInArrow(lambda it: _short_pieces(it, oversized_only, texts), _PIECES_SQL)
    long = docs.filter(F.length("text") > range_chars)
    if long.isEmpty():
        return pieces
    placed = _place(_ranges(long, range_chars))
    if oversized_only:
        placed = placed.filter("doc_tokens > chunk_size")
    if not texts:
        return pieces.unionByName(placed.withColumn("piece_text", F.lit(None).cast("string")).drop("byte_start", "byte_end"))
    return pieces.unionByName(_with_texts(placed, long))


def split_by_profile(docs: DataFrame, profiles: DataFrame, range_chars: int = DEFAULT_RANGE, oversized_only: bool = False, texts: bool = True) -> DataFrame:
    """:func:`split_documents` with each document's profile: its own, else (none or an unknown one)
    the default profile. ``profiles`` is a handful of settings; repeated rows count once."""
    p = profiles.select("index_profile_hash", "chunk_size", "overlap", "is_default").distinct()
    size, overlap = p.filter("is_default").agg(F.min(F.struct("chunk_size", "overlap")).alias("d")).select("d.chunk_size", "d.overlap").first()  # one row
    own = p.groupBy("index_profile_hash").agg(F.min(F.struct("chunk_size", "overlap")).alias("p"))
    joined = docs.select("doc_id", "text", "index_profile_hash").join(own, "index_profile_hash", "left")
    return split_documents(joined, F.coalesce("p.chunk_size", F.lit(size)), F.coalesce("p.overlap", F.lit(overlap)), range_chars, oversized_only, texts)


def oversized(pieces: DataFrame) -> DataFrame:
    """(doc_id, reason) from pieces: ``split`` for texts over their size, ``hard`` besides if an
    unbroken stretch is. Every oversized text has exactly one piece that starts at token 0."""
    first = pieces.filter((F.col("token_start") == 0) & (F.col("doc_tokens") > F.col("chunk_size")))
    reasons = F.when(F.col("longest_stretch") > F.col("chunk_size"), F.array(F.lit("split"), F.lit("hard"))).otherwise(F.array(F.lit("split")))
    return first.select("doc_id", F.explode(reasons).alias("reason"))


_FILES_SQL = "path string, byte_start bigint, byte_end bigint, char_start bigint, char_end bigint, token_start bigint, token_count bigint, cut_level int"


def split_files(spark: SparkSession, paths: list[str], size: int, overlap: int, range_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of UTF-8 files of any length, read by byte ranges from any file system that pyarrow opens
    (plain paths, file://, hdfs://, s3://, gs://), which all executors must reach.

    Gives ``path, byte_start, byte_end, char_start, char_end, token_start, token_count, cut_level``.
    A worker reads its range, a few bytes after it and the gap before it, never a file. Files must be
    UTF-8; empty files have no pieces; a path given twice is cut once. ``range_bytes`` does not change the
    pieces.
    """
    size = max(1, size)
    overlap = max(0, min(overlap, size - 1))
    paths = list(dict.fromkeys(paths))
    plan = [(i, p, r, n) for i, p in enumerate(paths) for n in [_open(p).size()] for r in range(-(-n // range_bytes))]
    if not plan:
        return spark.createDataFrame([], _FILES_SQL)
    grid = spark.createDataFrame(plan, "doc_id bigint, path string, r bigint, n bigint").repartition(min(len(plan), 4096), "doc_id", "r")

    def read(batch_iter):
        def rows():
            for batch in batch_iter:
                for x in batch.to_pylist():
                    yield (x["doc_id"], x["r"], *read_range(x["path"], x["r"] * range_bytes, range_bytes), size, overlap)

        yield from batches(rows(), _RANGES, 1)

    placed = _place(grid.mapInArrow(read, _RANGES_SQL))
    names = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "doc_id bigint, path string")
    return placed.join(names, "doc_id").select(*[c.split()[0] for c in _FILES_SQL.split(", ")])


def _open(path: str):
    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
    else:
        system = fs.LocalFileSystem()
    return system.open_input_file(path)


def _continues(b: int) -> bool:
    return b & 0xC0 == 0x80


def read_range(path: str, start: int, length: int) -> tuple[str, str]:
    """(halo, body): the characters whose first byte lies in [start, start + length) of a UTF-8 file, and
    the gap before them."""
    with _open(path) as f:
        data = f.read_at(length + 3, start)
        begin, end = 0, min(length, len(data))
        while start and begin < len(data) and _continues(data[begin]):
            begin += 1
        while end < len(data) and _continues(data[end]):
            end += 1
        edge, width, halo = start + begin, 256, ""
        while edge:
            low = max(0, edge - width)
            before = f.read_at(edge - low, low)
            skip = 0
            while low and skip < len(before) and _continues(before[skip]):
                skip += 1
            text = before[skip:].decode("utf-8")
            halo = gap_before(text, len(text))
            if len(halo) < len(text) or not low:
                break
            width *= 2
    return halo, data[begin:end].decode("utf-8")
