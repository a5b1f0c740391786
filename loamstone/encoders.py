"""Text encoders: a protocol, a deterministic one for tests, a decorator, and the wrapping as a UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from loamstone.errors import InvalidInput


class Encoder(Protocol):
    """Turns texts into vectors; ``kind`` is ``query`` or ``passage``."""

    dim: int
    model_id: str
    version: str

    def encode(self, texts: list[str], kind: str = "passage") -> list[list[float]]: ...


class FirstWordEncoder:
    """A one-hot vector at the hash of the first word: equal first words, equal vectors."""

    model_id, version = "first-word", "1"

    def __init__(self, dim: int = 8):
        self.dim = dim

    def encode(self, texts: list[str], kind: str = "passage") -> list[list[float]]:
        out = []
        for t in texts:
            h = 0
            for b in (t.split() or [""])[0].encode("utf-8"):
                h = (h * 33 + b) & 0xFFFFFFFFFFFFFFFF
            out.append([1.0 if i == h % self.dim else 0.0 for i in range(self.dim)])
        return out


# What embedding models want before a query and before a passage, by name.
PROMPTS = {
    "nomic-embed-text": ("search_query: ", "search_document: "),
    "nomic-embed-text-v2-moe": ("search_query: ", "search_document: "),
    "snowflake-arctic-embed": ("query: ", ""),
    "snowflake-arctic-embed2": ("query: ", ""),
    "qwen3-embedding": ("Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery: ", ""),
    "embeddinggemma": ("task: search result | query: ", "title: none | text: "),
}


def prompts_of(model: str) -> tuple[str, str]:
    """What a model wants before queries and passages, its tag aside; nothing for models not known."""
    return PROMPTS.get(model.partition(":")[0], ("", ""))


def prompted(inner: Encoder) -> Encoder:
    """An encoder with the prompts its model wants."""
    query, passage = prompts_of(inner.model_id)
    return PrefixedEncoder(inner, query, passage) if query or passage else inner


class PrefixedEncoder:
    """Another encoder with a text put before every query and passage."""

    def __init__(self, inner: Encoder, query_prefix: str = "", passage_prefix: str = ""):
        self.inner, self.dim, self.model_id = inner, inner.dim, inner.model_id
        self.version = f"{inner.version}+{query_prefix}|{passage_prefix}"
        plain = lambda p: p.replace("\\n", "\n").replace("\\t", "\t")  # noqa: E731  (settings write them as two characters)
        self.prefix = {"query": plain(query_prefix), "passage": plain(passage_prefix)}

    def encode(self, texts: list[str], kind: str = "passage") -> list[list[float]]:
        return self.inner.encode([self.prefix[kind] + t for t in texts], kind)


def encode_column(df: DataFrame, text: str, make: Callable[[], Encoder], kind: str = "passage", to: str = "embedding") -> DataFrame:
    """``df`` with the vectors of a text column; the encoder is made once a worker."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for s in parts:
            v = encoder.encode(s.fillna("").tolist(), kind)
            if any(len(x) != encoder.dim for x in v):
                raise InvalidInput("encoder gave a vector of another dimension")
            yield pd.Series(v)

    return df.withColumn(to, vectors(text))
