"""Functions that the JVM's built-ins do not offer: plain Python, and Arrow UDFs over them."""

from __future__ import annotations

import json
import re
import struct

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamstone.errors import InvalidInput
from loamstone.functions.columns import col
from loamstone.functions.text import SECRET_PREFIX

# Constants of the 64-bit FNV-1a hash.
_FNV_BASIS, _FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3

# Names whose values are secrets, marks put in their place, lines a code fence keeps.
SENSITIVE_KEYS = ("api_key", "apikey", "api-key", "access_key", "access-key", "private_key", "private-key", "secret", "token", "password", "passwd", "auth", "authorization")
REDACTED, FENCE_TRUNCATED = "[redacted]", "[code truncated]"
FENCE_LINES = 12


def canonical_json(value) -> str:
    """JSON with keys sorted at every level and no white space."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fnv1a64(text: str) -> str:
    h = _FNV_BASIS
    for b in text.encode("utf-8"):
        h = ((h ^ b) * _FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"


def pack_floats(values: list[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def unpack_floats(data: bytes) -> list[float]:
    if len(data) % 4:
        raise InvalidInput("packed vector is not a whole number of floats")
    return list(struct.unpack(f"<{len(data) // 4}f", data))


# Secrets are found by one pattern over whole texts, which the JVM and Python's regex module read alike. A
# word runs between spaces and line ends; its edge is what stands around its letters, digits and -_.+/=.
_CORE, _EDGE = r"\p{L}\p{N}\-_.+/=", r"[^ \n\p{L}\p{N}\-_.+/=]"
_KEYS = "(?i:" + "|".join(re.escape(k) for k in sorted(SENSITIVE_KEYS, key=len, reverse=True)) + ")"
_NO_WORD = r"[^ \n\p{L}\p{N}_]"
_ANNOUNCER = rf"(?:{_NO_WORD}*_*(?:(?i:bearer)|{_KEYS})_*{_NO_WORD}*|[^ =\n]*{_KEYS}{_NO_WORD}*[=:])"
_VALUE = rf"(?:{_EDGE}*[{_CORE}]){{8}}[^ \n]*"
_LOWER, _UPPER, _DIGIT = (rf"(?=[^{c} \n]*[{c}])" for c in ("a-z", "A-Z", "0-9"))
_SHAPES = (
    rf"(?=[^ \n]{{11}}[^ \n]*[{_CORE}])(?i:{SECRET_PREFIX[1:]})[^ \n]*",
    rf"(?=[^ \n]{{23}}[^ \n]*[{_CORE}])eyJ[^ \n.]*\.[^ \n.]*\.[^ \n]*",
    rf"(?:AKIA[A-Z0-9]{{16}}|[0-9A-Fa-f]{{40,}})(?={_EDGE}*(?:[ \n]|\z)){_EDGE}*",
    rf"(?:{_LOWER}{_UPPER}|{_LOWER}{_DIGIT}|{_UPPER}{_DIGIT})[A-Za-z0-9+/=_\-]{{32,}}(?={_EDGE}*(?:[ \n]|\z)){_EDGE}*",
)
_SECRET = rf"(?<![^ \n])(?:({_ANNOUNCER} [ =:]*(?<= )){_VALUE}|([^ =\n]*{_KEYS}[^\p{{L}}\p{{N}}_= \n-]*=)[^ \n]+|([^ :\n]*{_KEYS}[^\p{{L}}\p{{N}}_: \n-]*:)[^ \n]+|{_EDGE}*(?:{'|'.join(_SHAPES)}))"

_SPACE = r"\p{Z}\t\r\f\x0B"
_FENCE = rf"(?<=\n)(?=[{_SPACE}]*```)"
_LONG_BODY = rf"\A((?:[^\n]*\n){{{FENCE_LINES + 1}}})[\s\S]+"
_BEFORE_FENCES = ((r"\r\n", "\n"), (r"[ \t]+", " "), (r"(?<=\n) ?-----BEGIN[^\n]*KEY[^\n]*(?s:.*?)(?:\n ?-----END[^\n]*|\z)", f"{REDACTED} key block"))
_AFTER_FENCES = ((rf"\n[{_SPACE}\n]*\n", "\n\n"), (_SECRET, f"$1$2$3{REDACTED}"), (rf"\A[{_SPACE}\n]+|[{_SPACE}\n]+\z", ""))


def sanitize(text: str | None) -> str | None:
    """Text fit to be kept: key blocks dropped, code fences cut, runs of blank lines made one, spaces
    collapsed and secrets masked: what is assigned to a sensitive name, announced by the word before or shaped
    like a credential. Sanitising twice changes nothing more."""
    if text is None:
        return None

    def each(steps, t: str) -> str:
        for pattern, to in steps:
            t = regex.sub(pattern.replace(r"\z", r"\Z"), regex.sub(r"\$(\d)", r"\\\1", to.replace("\\", "\\\\")), t)
        return t

    parts = regex.split(_FENCE, each(_BEFORE_FENCES, "\n" + text))
    cut = [regex.sub(_LONG_BODY, rf"\1{FENCE_TRUNCATED}\n", p) if i % 2 else p for i, p in enumerate(parts)]
    return each(_AFTER_FENCES, "".join(cut))


def sanitized(text: Column | str) -> Column:
    """:func:`sanitize` as a column expression that stays in the JVM."""

    def each(steps, c: Column) -> Column:
        for pattern, to in steps:
            c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
        return c

    parts = F.split(each(_BEFORE_FENCES, F.concat(F.lit("\n"), col(text))), _FENCE)
    cut = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, F.lit(_LONG_BODY), F.lit(f"$1{FENCE_TRUNCATED}\n"))).otherwise(p))
    return each(_AFTER_FENCES, F.array_join(cut, ""))


@F.pandas_udf(StringType())
def fnv_hex(text: pd.Series) -> pd.Series:
    return text.map(fnv1a64, na_action="ignore")
