"""Limits of the contract, validators and clamps, for single values and for columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.errors import InvalidInput, InvalidQuery

# Limits of names, sizes and pages.
MAX_NAME_BYTES = 128
MAX_ID_BYTES = 512
MAX_SOURCE_BYTES = 256
MAX_TEXT_BYTES = 10 * 1024 * 1024
MAX_QUERY_BYTES = 64 * 1024
MAX_TOP_K = 1000
MANIFEST_PAGE, MAX_MANIFEST_PAGE = 1000, 5000
OVERFETCH, MAX_OVERFETCH = 4, 1024
BATCH_DOCS, BATCH_TEXT_BYTES = 100, 32 * 1024 * 1024
RESERVED_KEY = "_loamstone"

_NAME = re.compile(r"[A-Za-z0-9_:-]{1,128}\Z")


def collection_name(name: str) -> str:
    if not _NAME.match(name):
        raise InvalidInput(f"bad collection name {name!r}: 1 to {MAX_NAME_BYTES} of A-Z a-z 0-9 _ : -")
    return name


def _bounded(value: str, what: str, most: int, least: int = 1) -> str:
    size = len(value.encode("utf-8"))
    if size < least or size > most or "\0" in value:
        raise InvalidInput(f"{what} needs {least} to {most} bytes without NUL")
    return value


def doc_id(value: str) -> str:
    return _bounded(value, "doc_id", MAX_ID_BYTES)


def source_id(value: str) -> str:
    return _bounded(value, "source_id", MAX_SOURCE_BYTES)


def id_prefix(value: str) -> str:
    return _bounded(value, "prefix or cursor", MAX_ID_BYTES, 0)


def text(value: str, most: int = MAX_TEXT_BYTES) -> str:
    if len(value.encode("utf-8")) > most:
        raise InvalidInput(f"text is over {most} bytes")
    return value


def query(value: str) -> str:
    if not value.strip():
        raise InvalidQuery("query is blank")
    if len(value.encode("utf-8")) > MAX_QUERY_BYTES:
        raise InvalidQuery(f"query is over {MAX_QUERY_BYTES} bytes")
    return value


def metadata(value: dict | None) -> dict:
    value = value or {}
    if RESERVED_KEY in value:
        raise InvalidInput(f"metadata key {RESERVED_KEY} is reserved")
    return value


def alpha(value: float) -> float:
    if not 0.0 <= value <= 1.0:
        raise InvalidQuery(f"dense_alpha must lie in [0, 1], not {value}")
    return value


def top_k(value: int) -> int:
    return max(1, min(MAX_TOP_K, value))


def manifest_limit(value: int | None) -> int:
    return MANIFEST_PAGE if value is None else max(1, min(MAX_MANIFEST_PAGE, value))


def fetch_limit(k: int, postprocessed: bool) -> int:
    """Candidates to draw: four times as many if a filter, exclusion or rerank may drop some."""
    return max(1, min(k * OVERFETCH, MAX_OVERFETCH) if postprocessed else k)


def low_gain(value: float) -> float:
    return 0.05 if math.isnan(value) else max(0.0, min(1.0, value))


# Column forms of the validators, for checking a whole table at once.


def valid_name(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit("^[A-Za-z0-9_:-]{1,128}$")), F.lit(False))


def valid_query(c: Column) -> Column:
    return F.coalesce((F.octet_length(c) <= MAX_QUERY_BYTES) & F.regexp_like(c, F.lit(r"\S")), F.lit(False))


def clamped_top_k(c: Column, default: int = 16) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(MAX_TOP_K), F.coalesce(c, F.lit(default))))
