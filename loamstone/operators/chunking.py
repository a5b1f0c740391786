"""Cutting documents into chunks of words."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.functions.columns import col
from loamstone.functions.text import CHUNK_WORD

CHUNK_SIZE, OVERLAP = 64, 0
_BREAKS = regex.compile(r"(?w)\b")
_WORDY = regex.compile(r"[\p{L}\p{N}_]")
_BATCH = 5_000


def window(size: int, overlap: int) -> tuple[int, int]:
    """(size, step): a size of 1 at least, an overlap under it."""
    size = max(1, size)
    return size, size - max(0, min(overlap, size - 1))


def chunk_pattern(size: int) -> str:
    """Up to ``size`` words with what stands between them, as one match."""
    gap = r"[^\p{L}\p{N}\p{M}_]+"
    return f"{CHUNK_WORD}(?:{gap}{CHUNK_WORD}){{0,{max(1, size) - 1}}}"


def chunks_of(text: Column | str, size: int = CHUNK_SIZE) -> Column:
    """The chunks of a text without overlap, as an array; all in the JVM."""
    return F.regexp_extract_all(col(text), F.lit(chunk_pattern(size)), F.lit(0))


def word_count(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(CHUNK_WORD)).cast("bigint")


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """A row a chunk, without overlap: all columns but ``text``, then ``chunk_idx, chunk_text,
    token_count``. Texts without words and null texts have no chunks. No shuffle, no Python."""
    rest = [c for c in docs.columns if c != "text"]
    cut = docs.select(*rest, F.posexplode(chunks_of("text", size)).alias("chunk_idx", "chunk_text"))
    return cut.withColumn("chunk_idx", F.col("chunk_idx").cast("bigint")).withColumn("token_count", word_count("chunk_text"))


#: A text from its first word to its last.
WHOLE = f"(?s){CHUNK_WORD}(?:.*{CHUNK_WORD})?"


def one_chunk_documents(docs: DataFrame) -> DataFrame:
    """:func:`chunk_documents` with one chunk a text, from its first word to its last, however long."""
    whole = docs.withColumn("chunk_text", F.regexp_extract("text", WHOLE, 0)).filter("chunk_text <> ''")
    rest = [c for c in docs.columns if c != "text"]
    return whole.select(*rest, F.lit(0).cast("bigint").alias("chunk_idx"), "chunk_text", word_count("chunk_text").alias("token_count"))


def words(text: str) -> list[tuple[int, int]]:
    """Spans of words by the Unicode word-boundary rules: parts between boundaries with a letter, a
    digit or an underscore in them."""
    edges = [m.start() for m in _BREAKS.finditer(text)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if _WORDY.search(text, a, b)]


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, words) of the chunks of a text; each begins ``size - overlap`` words after the last."""
    size, step = window(size, overlap)
    spans = words(text)
    out = []
    for at in range(0, len(spans), step):
        part = spans[at : at + size]
        out.append((part[0][0], part[-1][1], len(part)))
        if at + size >= len(spans):
            break
    return out


_CHUNK = pa.schema([("doc_id", pa.string()), ("chunk_idx", pa.int64()), ("chunk_text", pa.string()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()), ("token_count", pa.int64())])
_CHUNK_SQL = "doc_id string, chunk_idx bigint, chunk_text string, char_start bigint, char_end bigint, byte_start bigint, byte_end bigint, token_count bigint"


def chunk_documents_exact(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks by Unicode word boundaries, with overlap and with offsets in characters and in bytes of the
    document. ``docs`` needs ``doc_id`` (string) and ``text``; null texts have no chunks."""

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                at = nbytes = 0
                for idx, (start, end, n) in enumerate(chunk_text(text or "", size, overlap)):
                    if start >= at:
                        nbytes += len(text[at:start].encode("utf-8"))
                    else:
                        nbytes -= len(text[start:at].encode("utf-8"))
                    at = start
                    piece = text[start:end]
                    rows.append((doc_id, idx, piece, start, end, nbytes, nbytes + len(piece.encode("utf-8")), n))
                    if len(rows) >= _BATCH:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)

    return docs.select("doc_id", "text").mapInArrow(cut, _CHUNK_SQL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CHUNK)], schema=_CHUNK)
