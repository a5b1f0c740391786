"""Collapsing records that say the same in another layout.

Each distinct text is read once into fields: a list of key-value fields in any notation gives its
fields, any other text is one field without a name. A text that may be either (names of many words, or
of several between commas and colons) is a list if all its names are names in other texts too. Each
distinct raw name or value is canonicalised once (width, composed accents, folded case; letters, digits
and their marks only) and gets an integer from a dictionary; a record becomes a sorted tuple of (name,
value) integers, and the compact tuples are grouped.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.llm.tokens import batches
from loamstone.session import materialise

_KEEP = regex.compile(r"[^\p{L}\p{N}\p{M}]+|[\uFE00-\uFE0F]+")
_SPLITS = tuple(re.compile(x) for x in (r"\n+", r"\s*\|\s*", r"\s*;\s*", r"\s*[,，、]\s*", r"\t+", r"\s+(?=[^\s=:]+=)"))
_COMMAS = _SPLITS[3]
_SEPARATOR = re.compile("=>|[:=：＝]")
_EDGES = " \t\r\n\"'“”„«»‘’`>*-•#"
#: Names of more words than this are doubtful.
_NAME_WORDS = 4
#: Names are joined by broadcast up to this many.
_FEW_NAMES = 100_000

#: Full-width and half-width forms and the characters they are forms of.
_WIDTH = {c: d for c in (0x3000, *range(0xFF01, 0xFFEF)) if (d := unicodedata.decomposition(chr(c)))[:5] in ("<wide", "<narr")}
_WIDTH = {c: chr(int(d.split()[1], 16)) for c, d in _WIDTH.items()}


def canonical(text: str) -> str:
    """Letters, digits and their marks in order; case, width and composition of accents aside. Other
    compatibility forms (superscripts, circled digits, fractions, ligatures) stay what they are."""
    composed = unicodedata.normalize("NFC", text.translate(_WIDTH))
    return unicodedata.normalize("NFC", _KEEP.sub("", unicodedata.normalize("NFC", composed.casefold())))


def _unwrap(text: str) -> str:
    return text.strip().strip("\"'“”„«»‘’`").strip()


def read_fields(text: str) -> list[tuple[str, str]] | None:
    """Fields of a key-value list, or None for any other text.

    A list has at least two fields: a JSON object (a nested one gives a field for each leaf, named by its
    path), or parts separated by line ends, bars, semicolons, commas, tabs or spaces before ``name=``, of
    which every one is ``name: value`` or ``name = value``. Prose has commas and colons too, so parts
    between commas whose names have several words need the equals sign, and names have four words at
    most; for the others see :func:`doubtful_fields`.
    """
    start, end = text.find("{"), text.rfind("}")
    if 0 <= start < end and not _KEEP.sub("", text[:start] + text[end + 1 :]):
        try:
            leaves = list(_leaves(json.loads(text[start : end + 1], object_pairs_hook=dict_pairs, parse_int=str, parse_float=str), ""))
        except (ValueError, RecursionError):
            leaves = []
        if len(leaves) > 1:
            return leaves
    return _first_list(text, True)


def doubtful_fields(text: str) -> list[tuple[str, str]] | None:
    """Fields of a text that :func:`read_fields` does not take for a list although it has the form of one."""
    return _first_list(text, False)


class dict_pairs(list):
    """The (key, value) pairs of a JSON object, repeated keys included."""


def _leaves(value, path: str):
    if isinstance(value, dict_pairs):
        for k, v in value:
            yield from _leaves(v, f"{path}/{k}" if path else k)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from _leaves(v, f"{path}/{i}")
    else:
        yield path, _scalar(value)


def _first_list(text: str, sure: bool) -> list[tuple[str, str]] | None:
    body = _unwrap(text)
    body = body[1:-1] if body[:1] in "{[(" and body[-1:] in "}])" else body
    if not _SEPARATOR.search(body):
        return None
    for split in _SPLITS:
        fields = _fields(body, split, sure)
        if fields:
            return fields
    return None


def _fields(body: str, split: re.Pattern, sure: bool) -> list[tuple[str, str]] | None:
    """Fields if there are two parts or more and each is one; ``sure``: with a name of few words, between
    commas one or with an equals sign."""
    parts = [p for p in split.split(body) if _KEEP.sub("", p)]
    if len(parts) < 2:
        return None
    fields = []
    for p in parts:
        m = _SEPARATOR.search(p)
        name = m and p[: m.start()].strip(_EDGES)
        if not name or "\n" in name or not _KEEP.sub("", name):
            return None
        if sure and not (split is _COMMAS and len(name.split()) == 1):  # a word may have parts: underscores, hyphens
            if len(re.split(r"[\s_\-]+", name)) > _NAME_WORDS or split is _COMMAS and m.group() in ":：":
                return None
        fields.append((name, p[m.end() :].strip()))
    return fields


def _scalar(v) -> str:
    return v if isinstance(v, str) else json.dumps(v)


def _parse(batch_iter):
    """(text_key, is_list, name, value) for each field; a prose text's value is the digest of its
    canonical form, so long texts are not shuffled again. A doubtful text gives the row of prose and,
    with a null ``is_list``, its fields."""
    schema = pa.schema([("text_key", pa.binary()), ("name", pa.string()), ("value", pa.string()), ("is_list", pa.bool_())])

    def rows():
        for batch in batch_iter:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                fields = read_fields(text)
                if fields is None:
                    yield key, None, hashlib.sha256(canonical(text).encode("utf-8", "surrogatepass")).hexdigest(), False
                    for name, value in set(doubtful_fields(text) or ()):
                        yield key, name, value, None
                else:
                    for name, value in set(fields):
                        yield key, name, value, True

    yield from batches(rows(), schema)


def _canonicalise(batch_iter):
    schema = pa.schema([("raw", pa.string()), ("canon", pa.string())])
    for batch in batch_iter:
        raw = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(raw, pa.string()), pa.array([canonical(x) for x in raw], pa.string())], schema=schema)


def dictionary(values: DataFrame) -> DataFrame:
    """(raw, id): equal ids for values with the same canonical form. ``values`` has one column."""
    distinct = values.toDF("raw").distinct().mapInArrow(_canonicalise, "raw string, canon string")
    forms = materialise(distinct)
    ids = materialise(forms.select("canon").distinct().select("canon", F.monotonically_increasing_id().alias("id")))
    return forms.join(ids, "canon").select("raw", "id")


def collapse_layouts(records: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each (``key``, group): ``keep_id`` (the smallest key of the group), ``copy_id`` (the
    row's own key), ``copies`` (distinct keys of the group) and ``is_list``.

    Rows without a key or a text have no group; an empty text, or one without letters and digits, is a
    copy of others such. Repeated rows count once. Exact copies are pre-aggregated before anything is
    parsed, groups are formed by partial aggregation, and the joins back to the rows are equi-joins whose
    hot keys Spark splits at run time (adaptive skew join), as the other side has one row a key.
    """
    rows = records.select(F.col(key).alias("copy_id"), F.col(text).alias("text")).filter("copy_id is not null and text is not null")
    rows = rows.withColumn("text_key", F.unhex(F.sha2("text", 256)))
    texts = rows.groupBy("text_key").agg(F.any_value("text").alias("text"))
    fields = materialise(texts.mapInArrow(_parse, "text_key binary, name string, value string, is_list boolean"))
    named = fields.filter("name is not null")
    words = dictionary(named.select("name").union(named.select("value")))
    names = materialise(words.join(named.select(F.col("name").alias("raw")).distinct(), "raw", "left_semi").select(F.col("raw").alias("name"), F.col("id").alias("n")))
    if names.count() <= _FEW_NAMES:
        names = F.broadcast(names)
    unlisted = fields.filter("not is_list")
    if not named.filter("is_list is null").isEmpty():
        doubtful = named.filter("is_list is null").select("text_key", "name").join(names, "name").select("text_key", "n").distinct()
        sure = named.filter("is_list").select("name").distinct().join(names, "name").select("n")
        shared = doubtful.groupBy("n").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("n")
        used = sure.union(shared).distinct()
        refuted = doubtful.join(used, "n", "left_anti").select("text_key").distinct()
        lists = materialise(doubtful.select("text_key").distinct().join(refuted, "text_key", "left_anti"))
        named = named.filter("is_list").unionByName(named.filter("is_list is null").join(lists, "text_key", "left_semi"))
        unlisted = unlisted.join(lists, "text_key", "left_anti")
    listed = (
        named.join(names, "name")
        .join(words.select(F.col("raw").alias("value"), F.col("id").alias("v")), "value")
        .groupBy("text_key")
        .agg(F.sort_array(F.collect_set(F.struct("n", "v"))).alias("tuple"))  # the fields of one text
        .select("text_key", F.lit(True).alias("is_list"), "tuple", F.lit(None).cast("string").alias("form"))
    )
    empty = F.array().cast("array<struct<n:bigint,v:bigint>>")
    prose = unlisted.select("text_key", "is_list", empty.alias("tuple"), F.col("value").alias("form"))
    tuples = materialise(listed.unionByName(prose))
    numbered = materialise(tuples.select("is_list", "tuple", "form").distinct().select("*", F.monotonically_increasing_id().alias("group_id")))
    same = ["is_list", "tuple", "form"]
    null_safe = [F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}")) for c in same]
    cond = null_safe[0] & null_safe[1] & null_safe[2]
    grouped = tuples.alias("t").join(numbered.alias("g"), cond).select("t.text_key", "t.is_list", "g.group_id")
    members = materialise(rows.select("copy_id", "text_key").distinct().join(grouped, "text_key").select("copy_id", "group_id", "is_list").distinct())
    kept = members.groupBy("group_id").agg(F.min("copy_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    return members.join(kept, "group_id").select("keep_id", "copy_id", "copies", "is_list")


def copies(groups: DataFrame) -> DataFrame:
    """(keep_id, copy_id) for every member of a group but the one that is kept."""
    return groups.filter(F.col("copy_id") != F.col("keep_id")).groupBy("copy_id").agg(F.min("keep_id").alias("keep_id")).select("keep_id", "copy_id")
