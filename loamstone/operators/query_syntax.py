"""A boolean query language over chunks: ``+must -not "a phrase" word^2 (a OR b) AND NOT c``.

Words side by side are alternatives, of which at least one must occur unless something else is required.
A query is parsed on the driver into a small tree. Its leaves are scored by one join with the postings;
whether a chunk matches is a column expression over which leaves it has.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.errors import InvalidQuery
from loamstone.functions.columns import all_of, any_of
from loamstone.functions.text import index_tokens
from loamstone.operators.search import PLACES, idf, tf_norm

_LEXEME = re.compile(r'\s*(?:(?P<open>\()|(?P<close>\))|(?P<sign>[+-](?=\S))|"(?P<phrase>[^"]*)"|(?P<word>[^\s()"^]+))(?:\^(?P<boost>\d+(?:\.\d+)?))?')
_RUN = re.compile(r"[^\W_]+")


@dataclass
class Leaf:
    tokens: tuple[str, ...]
    boost: float = 1.0


@dataclass
class Clauses:
    """Parts with their role: must, should or not."""

    parts: list[tuple[str, "Leaf | Clauses"]] = field(default_factory=list)


def parse(query: str) -> Clauses:
    tokens, at = [], 0
    text = query.rstrip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m or m.end() == at:
            raise InvalidQuery(f"cannot read the query at {text[at:at + 20]!r}")
        tokens.append(m)
        at = m.end()
    tree, rest = _clauses(tokens, 0, 0)
    if rest != len(tokens):
        raise InvalidQuery("a closing parenthesis too many")
    if not tree.parts:
        raise InvalidQuery("query is empty")
    return tree


def _clauses(tokens: list, at: int, depth: int) -> tuple[Clauses, int]:
    out, role, joined = Clauses(), None, None
    while at < len(tokens):
        m = tokens[at]
        if m["close"]:
            if not depth:
                return out, at
            break
        at += 1
        if m["sign"]:
            role = "must" if m["sign"] == "+" else "not"
            continue
        if m["word"] in ("AND", "OR", "NOT"):
            if m["word"] == "NOT":
                role = "not"
            elif not out.parts:
                raise InvalidQuery(f"{m['word']} needs something before it")
            else:
                joined = m["word"]
            continue
        if m["open"]:
            part, at = _clauses(tokens, at, depth + 1)
            if at >= len(tokens) or not tokens[at]["close"]:
                raise InvalidQuery("a parenthesis is not closed")
            boost = float(tokens[at]["boost"] or 1)
            _boost(part, boost)
            at += 1
        else:
            runs = tuple(_RUN.findall((m["phrase"] if m["phrase"] is not None else m["word"]).lower()))
            part = Leaf(runs, float(m["boost"] or 1)) if runs else None
        if part is not None:
            if joined == "AND":
                before, last = out.parts[-1]
                out.parts[-1] = (before if before == "not" else "must", last)
                role = role or "must"
            out.parts.append((role or "should", part))
        role, joined = None, None
    if role or joined:
        raise InvalidQuery("the query ends after an operator")
    return out, at


def _boost(part: "Leaf | Clauses", by: float) -> None:
    if isinstance(part, Leaf):
        part.boost *= by
    else:
        for _, p in part.parts:
            _boost(p, by)


def _leaves(tree: Clauses) -> list[Leaf]:
    out = []
    for _, p in tree.parts:
        out.extend([p] if isinstance(p, Leaf) else _leaves(p))
    return out


def _matches(part: "Leaf | Clauses", has: dict[int, Column]) -> Column:
    if isinstance(part, Leaf):
        return has[id(part)]
    must = [_matches(p, has) for r, p in part.parts if r == "must"]
    should = [_matches(p, has) for r, p in part.parts if r == "should"]
    never = [_matches(p, has) for r, p in part.parts if r == "not"]
    if not must and not should:
        return F.lit(False)
    found = all_of(must) if must else any_of(should)
    return found & ~any_of(never)


def _positive(part: "Leaf | Clauses", yes: bool = True) -> list[Leaf]:
    if isinstance(part, Leaf):
        return [part] if yes else []
    return [x for r, p in part.parts for x in _positive(p, yes and r != "not")]


def boolean_search(spark: SparkSession, query: str, chunks: DataFrame, posts: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, raw_score) of the chunks that match, scored by the positive leaves they have.

    A word that holds several tokens, like a quoted phrase, matches them side by side; its score is BM25
    with the number of such places as frequency and the sum of its words' rarities.
    """
    tree = parse(query)
    leaves = _leaves(tree)
    words = sorted({t for leaf in leaves for t in leaf.tokens})
    wanted = posts.filter(F.col("term").isin(words))
    df = {r["term"]: r["df"] for r in wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a query word
    n, avgdl = stats.first()
    freq = wanted.groupBy("doc_id", "chunk_idx").agg(F.max("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("tf"))  # as many as query words
    counts = [F.coalesce(F.try_element_at("tf", F.lit(leaf.tokens[0])), F.lit(0)) for leaf in leaves]
    if any(len(leaf.tokens) > 1 for leaf in leaves):
        freq = freq.join(chunks.select("doc_id", "chunk_idx", F.array_join(index_tokens("chunk_text"), "  ").alias("_words")), ["doc_id", "chunk_idx"])
        spaced = F.concat(F.lit(" "), F.col("_words"), F.lit(" "))
        for k, leaf in enumerate(leaves):
            if len(leaf.tokens) > 1:
                run = " " + "  ".join(leaf.tokens) + " "
                counts[k] = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(run), F.lit("")))) / len(run)).cast("int")
    has = {id(leaf): c > 0 for leaf, c in zip(leaves, counts)}
    index = {id(leaf): c for leaf, c in zip(leaves, counts)}
    score = F.lit(0.0)
    for leaf in _positive(tree):
        weight = sum((idf(F.lit(float(n)), F.lit(float(df.get(t, 0)))) for t in leaf.tokens), F.lit(0.0))
        score = score + F.when(has[id(leaf)], leaf.boost * weight * tf_norm(index[id(leaf)].cast("double"), F.col("dl"), F.lit(float(avgdl or 1)))).otherwise(0.0)
    return freq.filter(_matches(tree, has)).select("doc_id", "chunk_idx", F.round(score, PLACES).alias("raw_score"))
