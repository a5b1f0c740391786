"""Scalar text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamstone.functions.columns import col

# What counts as a word for the index, for chunking and for grouping.
INDEX_TOKEN = r"[\p{L}\p{N}]+"
CHUNK_WORD = r"[\p{L}\p{N}\p{M}_]+(?:['’.][\p{L}\p{N}\p{M}_]+)*"
LONGEST_TOKEN_BYTES = 40
LEAST_TERM_CHARS = 3


def index_tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, those of 40 bytes or more left out."""
    return F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(INDEX_TOKEN), F.lit(0)), lambda t: F.octet_length(t) < LONGEST_TOKEN_BYTES)


def grouping_terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits of three characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(col(text)), F.lit(INDEX_TOKEN), F.lit(0)), lambda t: F.length(t) >= LEAST_TERM_CHARS)


def collapse_spaces(text: Column | str) -> Column:
    """Runs of spaces and tabs become one space."""
    return F.regexp_replace(col(text), r"[ \t]+", " ")


def squeeze(text: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def plain_query(query: Column | str) -> Column:
    """A query without punctuation: letters, digits and single spaces."""
    return squeeze(F.regexp_replace(col(query), r"[^\p{L}\p{N}\s]", " "))


def answer_form(text: Column | str) -> Column:
    """Lower case, white space squeezed: the form in which answers are looked for."""
    return F.lower(squeeze(text))


def contains_answer(text: Column | str, answer: Column | str) -> Column:
    form = answer_form(answer)
    return (form != "") & F.contains(answer_form(text), form)


def squad_form(text: Column | str) -> Column:
    """Lower case without ASCII punctuation and the articles a, an, the; white space squeezed."""
    bare = F.regexp_replace(F.lower(col(text)), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(squeeze(bare), " "), lambda w: ~w.isin("a", "an", "the")), " ")


def session_of(doc_id: Column | str, separator: str = "::") -> Column:
    """The part of an id before the separator; the whole id without one."""
    return F.substring_index(col(doc_id), separator, 1)


def after_marker(text: Column | str, marker: str = "FINAL:") -> Column:
    """What follows the last marker, trimmed; null without one."""
    return F.when(F.contains(col(text), F.lit(marker)), F.trim(F.substring_index(col(text), marker, -1)))


def rich_text(summary: Column | str, detail: Column | str, most: int) -> tuple[Column, Column, Column]:
    """(text, characters of detail, whether detail was cut): a blank detail leaves the summary alone."""
    d = F.regexp_replace(col(detail), r"^\s+|\s+$", "")
    blank = F.coalesce(d == "", F.lit(True))
    part = F.left(d, F.lit(most))
    joined = F.concat(F.lit("summary: "), col(summary), F.lit("\ndetail: "), part)
    return F.when(blank, col(summary)).otherwise(joined), F.when(blank, F.lit(0)).otherwise(F.length(part)), F.when(blank, F.lit(False)).otherwise(F.length(d) > most)


# Reasons for refusing a text.
LOW_DENSITY = "alphanumeric density below 40% (likely noise or special-character spam)"
REPEATED_LINES = "repeated identical lines (no new information)"


def low_signal(text: Column | str, least_chars: int = 80) -> Column:
    """Too short, too little of it letters and digits, or one line over and over."""
    t = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    n = F.length(t)
    dense = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    repeated = (F.size(lines) >= 3) & (F.size(F.array_distinct(lines)) == 1)
    return F.coalesce((n < least_chars) | (dense < 0.4 * n) | repeated, F.lit(True))


def low_signal_reason(text: Column | str, least_chars: int = 80) -> Column:
    """Why a text is refused, null if it is not."""
    t = F.regexp_replace(col(text), r"^\s+|\s+$", "")
    n = F.length(t)
    dense = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    chars = F.coalesce(n, F.lit(0))
    short = F.concat(F.lit("text too short ("), chars.cast("string"), F.lit(f" chars; minimum {least_chars})"))
    return F.when(~low_signal(text, least_chars), F.lit(None)).when(chars < least_chars, short).when(dense < 0.4 * n, LOW_DENSITY).otherwise(REPEATED_LINES)


#: Characters of a turn that stand for it: short, and in detail.
TURN_CHARS, TURN_DETAIL = 120, 800


def short_turn(text: Column | str, most: int = TURN_CHARS) -> Column:
    """A turn by its beginning, white space squeezed."""
    return F.left(squeeze(text), F.lit(most))


def rich_turn(text: Column | str, clean, most: int = TURN_CHARS, detail: int = TURN_DETAIL) -> Column:
    """A turn by its beginning and, made fit by ``clean``, some of what follows."""
    whole = squeeze(text)
    return rich_text(F.left(whole, F.lit(most)), clean(F.substring(whole, most + 1, 1 << 30)), detail)[0]


def file_extension(path: Column | str) -> Column:
    """Lower-case extension; none for dot files, trailing dots and names without a dot."""
    name = F.substring_index(col(path), "/", -1)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))


def folder(path: Column | str) -> Column:
    """The first folder of a relative path, empty at the top."""
    return F.when(F.contains(col(path), F.lit("/")), F.substring_index(col(path), "/", 1)).otherwise("")


def rfc3339(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_head(text: Column | str) -> Column:
    """The date at the head of ``YYYY/MM/DD ...``; null if there is none."""
    return F.to_date(F.try_to_timestamp(F.left(col(text), F.lit(10)), F.lit("yyyy/MM/dd")))


def secret_shaped(token: Column | str) -> Column:
    """A token that looks like a credential whatever stands around it."""
    bare = F.regexp_replace(col(token), r"^[^\p{L}\p{N}\-_.+/=]+|[^\p{L}\p{N}\-_.+/=]+$", "")
    n = F.length(bare)
    prefixed = F.regexp_like(F.lower(bare), F.lit(SECRET_PREFIX)) & (n >= 12)
    jwt = F.regexp_like(bare, F.lit(r"^eyJ[^.]*\..*\.")) & (n >= 24)
    classes = F.regexp_like(bare, F.lit("[A-Z]")).cast("int") + F.regexp_like(bare, F.lit("[a-z]")).cast("int") + F.regexp_like(bare, F.lit("[0-9]")).cast("int")
    blob = F.regexp_like(bare, F.lit(r"^[A-Za-z0-9+/=_-]{32,}$")) & (classes >= 2)
    return prefixed | F.regexp_like(bare, F.lit("^AKIA[A-Z0-9]{16}$")) | jwt | F.regexp_like(bare, F.lit("^[0-9A-Fa-f]{40,}$")) | blob


# Beginnings of credentials.
SECRET_PREFIX = r"^(sk-|ghp_|gho_|ghu_|ghs_|github_pat_|xoxb-|xoxp-|xoxa-|xoxs-)"


def content_hash(text: Column | str, canonical_metadata: Column | str) -> Column:
    """SHA-256 over a tag, then text and canonical metadata, each behind its length in bytes."""
    t, m = col(text), col(canonical_metadata)
    return F.sha2(F.concat(F.lit("content:v1:"), F.octet_length(t).cast("string"), F.lit(":"), t, F.octet_length(m).cast("string"), F.lit(":"), m), 256)


def hash_state(content: Column | str, profile: Column | str, current: Column | str) -> Column:
    """ok, profile_stale, or legacy_missing without hashes."""
    return F.when(col(content).isNull() | col(profile).isNull(), "legacy_missing").when(col(profile) != col(current), "profile_stale").otherwise("ok")


def capsule_id() -> Column:
    return F.concat(F.lit("mem-"), F.regexp_replace(F.uuid(), "-", ""))
