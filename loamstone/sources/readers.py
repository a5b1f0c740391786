"""Readers of corpora, evaluation sets, conversations and folders of text files."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.errors import InvalidInput
from loamstone.files import exists
from loamstone.functions.text import date_head, file_extension, folder, rfc3339

_JSONL = "_id string, text string"


def read_jsonl(spark: SparkSession, path: str, schema: str = _JSONL, limit: int | None = None) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped, a bad line is an error. ``limit`` keeps the
    first by id."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.orderBy(df.columns[0]).limit(limit) if limit is not None else df


@dataclass
class BeirSet:
    """corpus (doc_id, text), queries (query_id, text), qrels (query_id, doc_id), answers (query_id, answer)."""

    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    answers: DataFrame | None


def read_beir(spark: SparkSession, path: str, split: str = "test", max_queries: int | None = None, max_docs: int | None = None) -> BeirSet:
    """A dataset of corpus.jsonl, queries.jsonl, qrels/<split>.tsv and, if there, answers.jsonl.

    Judgements above 0 count; queries without any are dropped. Of the rest the first by id are kept, and of
    the corpus the first by id plus every document that a kept query needs.
    """
    corpus = read_jsonl(spark, f"{path}/corpus.jsonl").toDF("doc_id", "text")
    queries = read_jsonl(spark, f"{path}/queries.jsonl").toDF("query_id", "text")
    lines = spark.read.schema("query_id string, iteration string, doc_id string, relevance string").option("sep", "\t").csv(f"{path}/qrels/{split}.tsv")
    three = lines.withColumn("_three", F.col("relevance").isNull())  # query, document, relevance
    qrels = three.select("query_id", F.when(F.col("_three"), F.col("iteration")).otherwise(F.col("doc_id")).alias("doc_id"), F.expr("try_cast(if(_three, doc_id, relevance) as int)").alias("rel"))
    qrels = qrels.filter("rel > 0").select("query_id", "doc_id").distinct()
    return limited_beir(BeirSet(corpus, queries, qrels, read_jsonl(spark, f"{path}/answers.jsonl", "_id string, answer string").toDF("query_id", "answer") if os.path.exists(f"{path}/answers.jsonl") else None), max_queries, max_docs)


def limited_beir(data: BeirSet, max_queries: int | None, max_docs: int | None) -> BeirSet:
    queries = data.queries.join(data.qrels.select("query_id"), "query_id", "left_semi")
    if max_queries is not None:
        queries = queries.orderBy("query_id").limit(max_queries)
    qrels = data.qrels.join(queries.select("query_id"), "query_id", "left_semi")
    corpus = data.corpus
    if max_docs is not None:
        first = corpus.orderBy("doc_id").limit(max_docs)
        needed = corpus.join(qrels.select("doc_id"), "doc_id", "left_semi").join(first.select("doc_id"), "doc_id", "left_anti")
        corpus = first.unionByName(needed)
    return BeirSet(corpus, queries, qrels, data.answers)


def qrels_by_text(passages: DataFrame, corpus: DataFrame, prefix: int = 80) -> DataFrame:
    """(query_id, doc_id): passages (query_id, text) found in a corpus (doc_id, text) by equal text, else by
    their first ``prefix`` characters; of several documents the smallest."""
    exact = passages.join(corpus.groupBy("text").agg(F.min("doc_id").alias("doc_id")), "text").select("query_id", "text", "doc_id")
    rest = passages.join(exact.select("query_id", "text"), ["query_id", "text"], "left_anti")
    heads = corpus.groupBy(F.left("text", F.lit(prefix)).alias("head")).agg(F.min("doc_id").alias("doc_id"))
    loose = rest.withColumn("head", F.left("text", F.lit(prefix))).join(heads, "head").select("query_id", "doc_id")
    return exact.select("query_id", "doc_id").union(loose).distinct()


_LONGMEM = """question_id string, question_type string, question string, answer string, question_date string,
haystack_dates array<string>, haystack_session_ids array<string>,
haystack_sessions array<array<struct<role:string,content:string>>>, answer_session_ids array<string>"""


def read_long_memory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, turns) of one JSON array of questions with their sessions.

    turns: question_id, session_id, session_pos, date (null if unreadable), turn, role, text, is_gold.
    """
    raw = spark.read.option("multiLine", True).schema(_LONGMEM).json(path)
    zipped = F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")
    sessions = raw.select("question_id", "answer_session_ids", F.posexplode(zipped).alias("session_pos", "s"))
    turns = sessions.select("question_id", "answer_session_ids", "session_pos", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("day"), F.posexplode("s.haystack_sessions").alias("turn", "t"))
    date = date_head("day")
    turns = turns.select("question_id", "session_id", "session_pos", date.alias("date"), "turn", F.col("t.role").alias("role"), F.col("t.content").alias("text"), F.array_contains("answer_session_ids", F.col("session_id")).alias("is_gold"))
    return raw.drop("haystack_dates", "haystack_session_ids", "haystack_sessions"), turns


def glob_pattern(glob: str) -> str:
    """A path glob as a regular expression: ** any folders, * and ? within one."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def read_folder(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md", "**/*.txt"), exclude: tuple[str, ...] = (), max_bytes: int = 10 << 20, max_files: int = 20_000) -> DataFrame:
    """(doc_id, text, ext, dir, created_at, source, mtime, readable) of the text files below a folder, a path or
    the address of one on any file system that Spark reads.

    ``doc_id`` is the path below ``root``. Files that are too large or not UTF-8 have no text and are not
    ``readable``; too many files are an error. Links that lead out of the folder are left out.
    """
    root = root.removeprefix("file://")
    local = "://" not in root
    real = os.path.realpath(root) if local else root.rstrip("/")
    if not (os.path.isdir(real) if local else exists(spark, real)):
        raise InvalidInput(f"{root} is not a folder")
    inside = real.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{real}" if local else real)
    rel = F.substring_index(F.regexp_replace("path", "^file:/+", "/") if local else F.col("path"), inside, -1)
    files = files.select(rel.alias("doc_id"), F.col("modificationTime").alias("mtime"), "length", "content")
    wanted = F.lit(False)
    for g in include:
        wanted = wanted | F.regexp_like("doc_id", F.lit(glob_pattern(g)))
    for g in exclude:
        wanted = wanted & ~F.regexp_like("doc_id", F.lit(glob_pattern(g)))
    links = [] if not local else [os.path.relpath(os.path.join(d, n), real) for d, ds, ns in os.walk(real) for n in [*ds, *ns] if os.path.islink(os.path.join(d, n)) and not os.path.realpath(os.path.join(d, n)).startswith(inside)]
    for link in links:
        wanted = wanted & ~((F.col("doc_id") == link) | F.startswith("doc_id", F.lit(link + "/")))
    files = files.filter(wanted)
    if files.limit(max_files + 1).count() > max_files:
        raise InvalidInput(f"over {max_files} files")
    text = F.when(F.col("length") <= max_bytes, F.try_validate_utf8(F.col("content").cast("string")))
    return files.select("doc_id", text.alias("text"), file_extension("doc_id").alias("ext"), folder("doc_id").alias("dir"), rfc3339("mtime").alias("created_at"), F.lit("fs").alias("source"), "mtime").withColumn("readable", F.col("text").isNotNull())
