"""The token that sizes, shingles and term statistics count, for Java's and Python's engines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern (one character of Thai, kana or Han, or up to 24 word characters).
SINGLE_CHARS = r"\u0E00-\u0E7F\u3040-\u30FF\u3400-\u9FFF"
WORD_CHARS = r"0-9A-Za-z_\u00C0-\u024F\u0300-\u036F\u0370-\u052F\u0620-\u065F\u0900-\u0963\u0966-\u097F"
TOKEN_MAX = 24
TOKEN_PATTERN = rf"[{SINGLE_CHARS}]|[{WORD_CHARS}]{{1,{TOKEN_MAX}}}"
#: The same for engines that write code points as \x{...}.
TOKEN_PATTERN_SQL = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", TOKEN_PATTERN)
TOKEN = re.compile(TOKEN_PATTERN)

#: Rows of an Arrow batch that an operator emits at once.
BATCH = 20_000


def token_count(text: Column) -> Column:
    """Number of tokens, in the JVM; null for a null text."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")


def batches(rows, schema: pa.Schema, size: int = BATCH):
    """Arrow batches of up to ``size`` rows from an iterator of tuples."""
    buffer = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield to_batch(buffer, schema)
            buffer = []
    if buffer:
        yield to_batch(buffer, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
