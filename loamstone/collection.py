"""Collections: named, versioned sets of documents with their chunks and postings, and the calls on them.

A collection is a folder on any file system that Spark reaches. Documents are spread over buckets by a hash
of their id; a bucket is a row of *layers*. A commit writes one layer: the documents it puts in place with
their chunks and postings (sorted by term), and the ids of earlier documents that are gone by it. ``CURRENT``
names every bucket's layers and counts; a commit puts a new one in place as its last step, so readers see all
of it or nothing, and one that fails leaves only garbage. What a commit writes follows its own size. Buckets
of many layers are merged, their chunks, vectors and postings carried over as they are.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from datetime import datetime, timezone

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone import files, limits
from loamstone.config import Config, load
from loamstone.encoders import Encoder, encode_column
from loamstone.errors import Conflict, InvalidInput, InvalidQuery, SchemaError, UnknownCollection, UnknownDocument
from loamstone.functions.exact import canonical_json, sanitize
from loamstone.functions.text import content_hash
from loamstone.operators import consolidate as grouping
from loamstone.operators import delta as deltas
from loamstone.operators import interleave as rounds
from loamstone.operators import query_syntax, search
from loamstone.operators.chunking import chunk_documents_exact
from loamstone.operators.memory import MemoryKind, remember_batch
from loamstone.session import materialise
from loamstone.sources.readers import read_folder

SCHEMA_VERSION = 1
DOCUMENT = "doc_id string, text string, metadata map<string,string>, created_at timestamp, content_hash string, index_profile_hash string, source_id string, raw_hash string, embedding array<float>"
CHUNK = "doc_id string, chunk_idx bigint, chunk_text string, char_start bigint, char_end bigint, byte_start bigint, byte_end bigint, token_count bigint, terms bigint, embedding array<float>"
POSTING = "term string, doc_id string, chunk_idx bigint, dl bigint, tf bigint"
#: Layers of a bucket from which it is merged.
MANY_LAYERS = 12
_COUNTS = ("documents", "chunks", "tokens", "terms")


def columns_of(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def profile_hash(chunk_size: int, overlap: int, encoder: Encoder | None) -> str:
    """Identity of how texts are cut and encoded."""
    about = {"chunk_size": chunk_size, "overlap": overlap, "embedding": {"active": encoder is not None}}
    if encoder is not None:
        about["embedding"] |= {"model_id": encoder.model_id, "version": encoder.version, "dim": encoder.dim}
    return hashlib.sha256(("profile:v1:" + canonical_json(about)).encode()).hexdigest()


class Collection:
    """One collection; made by :class:`Engine`."""

    def __init__(self, engine: "Engine", name: str):
        self.engine, self.spark, self.name = engine, engine.spark, limits.collection_name(name)
        self.path = f"{engine.root}/{name}"
        self.encoder = engine.encoder
        self.chunking = engine.config.chunking
        self.lock = engine.lock_of(name)

    # -- versions --------------------------------------------------------------------------------

    def exists(self) -> bool:
        return files.exists(self.spark, f"{self.path}/_meta.json")

    def _create(self) -> None:
        if self.exists():
            return
        files.make_folder(self.spark, self.path)
        self._put("CURRENT", {"version": 0, "buckets": {}})
        self._put("_meta.json", {"schema_version": SCHEMA_VERSION, "buckets": self.engine.config.buckets})

    def _put(self, name: str, value: dict) -> None:
        files.write_json(self.spark, f"{self.path}/{name}", value)

    def _meta(self) -> dict:
        try:
            meta = files.read_json(self.spark, f"{self.path}/_meta.json")
            if meta is None:
                raise UnknownCollection(self.name)
            version = int(meta["schema_version"])
        except (ValueError, KeyError, TypeError) as e:
            raise SchemaError(f"{self.name}: _meta.json is malformed") from e
        if version > SCHEMA_VERSION:
            raise SchemaError(f"{self.name} has schema {version}; this library reads up to {SCHEMA_VERSION}")
        return meta

    def _snapshot(self) -> dict:
        self._meta()
        return files.read_json(self.spark, f"{self.path}/CURRENT")

    def _read(self, kind: str, schema: str, snapshot: dict | None = None, buckets: set[str] | None = None) -> DataFrame:
        """Rows in force of a kind, of some buckets only if given: those of every layer but of the documents that
        a later layer lets go."""
        snapshot = snapshot or self._snapshot()
        layers = [(b, x) for b, info in snapshot["buckets"].items() if buckets is None or b in buckets for x in info["layers"]]
        where = lambda what: [f"{self.path}/{x['folder']}/{what}/b={b}" for b, x in layers if x[what]]
        if not where(kind):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*where(kind))
        if not where("gone"):
            return rows
        layer = F.regexp_extract(F.col("_metadata.file_path"), r".*/v(\d+)-[0-9a-f]{8}/", 1).cast("bigint")
        gone = self.spark.read.schema("doc_id string").parquet(*where("gone")).select("doc_id", layer.alias("_gone")).groupBy("doc_id").agg(F.max("_gone").alias("_gone"))
        return rows.select("*", layer.alias("_layer")).join(gone, "doc_id", "left").filter("_gone is null or _layer >= _gone").select(*columns_of(schema))

    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENT)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNK)

    def postings(self) -> DataFrame:
        return self._read("postings", POSTING)

    def _bucket(self, column: str = "doc_id"):
        return F.pmod(F.xxhash64(column), F.lit(self._meta()["buckets"])).cast("int")

    def _buckets_of(self, doc_ids: list[str]) -> set[str]:
        """The buckets of some ids, without a job: the hash is Spark's."""
        n = self._meta()["buckets"]
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        return {str(signed(xxhash.xxh64_intdigest(d.encode(), seed=42)) % n) for d in doc_ids}

    def _commit(self, upserts: DataFrame | None, deletes: DataFrame | None) -> dict:
        """Write a layer and put the version with it in place: {chunks written, documents gone}. Called under
        the lock. Ids of ``upserts`` are unique."""
        snapshot = self._snapshot()
        folder = self._folder(snapshot)
        layer = self._write(upserts, folder) if upserts is not None else {}
        keys = [self.spark.read.schema("doc_id string, b int").parquet(f"{self.path}/{folder}/documents").select("doc_id")] if layer else []
        keys += [deletes.select("doc_id")] if deletes is not None else []
        lost: dict[str, dict] = {}
        if keys and snapshot["buckets"]:
            keys = materialise((keys[0] if len(keys) == 1 else keys[0].union(keys[1])).distinct())
            touched = {str(r[0]) for r in keys.select(self._bucket().alias("b")).distinct().collect()}  # at most the number of buckets
            lost = self._let_go(keys, snapshot, touched, folder)
        for b in {*layer, *lost}:
            info = snapshot["buckets"].setdefault(b, {"layers": []} | dict.fromkeys(_COUNTS, 0))
            new, old = layer.get(b, {}), lost.get(b, {})
            for c in _COUNTS:
                info[c] += new.get(c, 0) - old.get(c, 0)
            info["layers"].append({"folder": folder, "documents": new.get("documents", 0), "chunks": new.get("chunks", 0), "postings": new.get("terms", 0), "gone": old.get("documents", 0)})
        self._put("CURRENT", snapshot)
        many = {b for b in {*layer, *lost} if len(snapshot["buckets"][b]["layers"]) > MANY_LAYERS}
        if many:
            self._merge(snapshot, many)
        return {"chunks": sum(x["chunks"] for x in layer.values()), "gone": sum(x["documents"] for x in lost.values())}

    def _folder(self, snapshot: dict) -> str:
        snapshot["version"] += 1
        return f"v{snapshot['version']:08d}-{uuid.uuid4().hex[:8]}"

    def _let_go(self, keys: DataFrame, snapshot: dict, touched: set[str], folder: str) -> dict[str, dict]:
        """Writes the ids among ``keys`` that are there; gives what goes with them, by bucket."""
        old = self._read("documents", "doc_id string", snapshot, touched).join(keys, "doc_id", "left_semi")
        self._spread(old, f"{folder}/gone")
        gone = self.spark.read.schema("doc_id string, b int").parquet(f"{self.path}/{folder}/gone")
        lost = {str(r["b"]): {"documents": r["n"], "chunks": 0, "tokens": 0, "terms": 0} for r in gone.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket
        if lost:
            chunks = self._read("chunks", "doc_id string, token_count bigint, terms bigint", snapshot, set(lost)).join(gone, "doc_id")
            for r in chunks.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"), F.sum("terms").alias("p")).collect():
                lost[str(r["b"])] |= {"chunks": r["n"], "tokens": r["t"], "terms": r["p"]}
        return lost

    def _spread(self, rows: DataFrame, place: str) -> None:
        """Even files, also of a large bucket."""
        rows.withColumn("b", self._bucket()).hint("rebalance", "b").write.partitionBy("b").parquet(f"{self.path}/{place}")

    def _write(self, docs: DataFrame, folder: str) -> dict[str, dict]:
        """Documents, chunks and postings of a layer, and the counts of each bucket."""
        out = f"{self.path}/{folder}"
        self._spread(docs.select(*columns_of(DOCUMENT)), f"{folder}/documents")
        docs = self.spark.read.schema(f"{DOCUMENT}, b int").parquet(f"{out}/documents")
        chunks = chunk_documents_exact(docs, self.chunking.chunk_size, self.chunking.overlap).withColumn("terms", F.size(search.index_tokens("chunk_text")).cast("bigint"))
        if self.encoder is not None:
            encoder = self.encoder
            chunks = encode_column(chunks, "chunk_text", lambda: encoder)
        else:
            chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        self._spread(chunks.select(*columns_of(CHUNK)), f"{folder}/chunks")
        chunks = self.spark.read.schema(f"{CHUNK}, b int").parquet(f"{out}/chunks")
        self._spread_postings(search.postings(chunks), folder)
        found: dict[str, dict] = {}
        for r in docs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a bucket
            found[str(r["b"])] = {"documents": r["n"], "chunks": 0, "tokens": 0, "terms": 0}
        for r in chunks.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.sum("token_count").alias("t"), F.sum("terms").alias("p")).collect():
            found[str(r["b"])] |= {"chunks": r["n"], "tokens": r["t"], "terms": r["p"]}
        return found

    def _spread_postings(self, posts: DataFrame, folder: str) -> None:
        """Files sorted by term: a search reads the row groups of its words."""
        posts = posts.select(*columns_of(POSTING)).withColumn("b", self._bucket())
        posts.hint("rebalance", "b").sortWithinPartitions("b", "term").write.partitionBy("b").parquet(f"{self.path}/{folder}/postings")

    def _merge(self, snapshot: dict, buckets: set[str]) -> None:
        """Make one layer of all layers of some buckets, as a version of its own."""
        folder = self._folder(snapshot)
        self._spread(self._read("documents", DOCUMENT, snapshot, buckets), f"{folder}/documents")
        self._spread(self._read("chunks", CHUNK, snapshot, buckets), f"{folder}/chunks")
        self._spread_postings(self._read("postings", POSTING, snapshot, buckets), folder)
        for b in buckets:
            info = snapshot["buckets"][b]
            info["layers"] = [{"folder": folder, "documents": info["documents"], "chunks": info["chunks"], "postings": info["terms"], "gone": 0}]
        self._put("CURRENT", snapshot)

    def compact(self, keep_versions: bool = False) -> int:
        """Merge buckets of several layers and remove folders that no bucket refers to; gives the number of
        folders removed. Readers of older versions must have finished."""
        with self.lock:
            snapshot = self._snapshot()
            many = {b for b, i in snapshot["buckets"].items() if len(i["layers"]) > 1}
            if many:
                self._merge(snapshot, many)
            used = {x["folder"] for i in snapshot["buckets"].values() for x in i["layers"]}
            old = [] if keep_versions else [d for d in files.names(self.spark, self.path) if d.startswith("v") and d not in used]
            for d in old:
                files.delete(self.spark, f"{self.path}/{d}")
            return len(old)

    # -- writing ---------------------------------------------------------------------------------

    def current_profile(self) -> str:
        return profile_hash(self.chunking.chunk_size, self.chunking.overlap, self.encoder)

    def _rows(self, docs: list[dict], source_id: str | None) -> DataFrame:
        """Checked documents as a table; of one id the last in the list counts."""
        rows = {}
        for d in docs:
            limits.doc_id(d["doc_id"])
            limits.text(d["text"])
            meta = {k: canonical_json(v) for k, v in limits.metadata(d.get("metadata")).items()}
            rows[d["doc_id"]] = (d["doc_id"], d["text"], meta, d.get("created_at") or datetime.now(timezone.utc), canonical_json(dict(sorted(meta.items()))), source_id, d.get("raw_hash"))
        df = self.spark.createDataFrame(list(rows.values()), "doc_id string, text string, metadata map<string,string>, created_at timestamp, canon string, source_id string, raw_hash string")
        df = df.withColumn("content_hash", content_hash("text", "canon")).withColumn("index_profile_hash", F.lit(self.current_profile()))
        return df.withColumn("embedding", F.lit(None).cast("array<float>")).select(*columns_of(DOCUMENT))

    def index(self, doc_id: str, text: str, metadata: dict | None = None, created_at: datetime | None = None) -> int:
        """Put one document in place; gives its number of chunks."""
        return self.index_batch([{"doc_id": doc_id, "text": text, "metadata": metadata, "created_at": created_at}])

    def index_batch(self, docs: list[dict]) -> int:
        """Put documents in place, all or none; gives the number of chunks written."""
        rows = self._rows(docs, None)
        with self.lock:
            self._create()
            return self._commit(rows, None)["chunks"]

    def _ids(self, doc_ids: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")

    def _table_rows(self, docs: DataFrame, source_id: str | None) -> DataFrame:
        """A table (doc_id, text, metadata, created_at) as documents, hashed as :meth:`_rows` does."""
        canon = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))))))
        return docs.select("doc_id", "text", "metadata", "created_at", content_hash("text", canon).alias("content_hash"), F.lit(self.current_profile()).alias("index_profile_hash"), F.lit(source_id).cast("string").alias("source_id"), F.lit(None).cast("string").alias("raw_hash"), F.lit(None).cast("array<float>").alias("embedding"))

    def index_table(self, docs: DataFrame, source_id: str | None = None) -> None:
        """Put a table (doc_id, text, metadata map of JSON values, created_at) in place; ids must be unique."""
        rows = self._table_rows(docs, source_id)
        with self.lock:
            self._create()
            self._commit(rows, None)

    def delete(self, doc_id: str) -> None:
        self.delete_batch([doc_id])

    def delete_batch(self, doc_ids: list[str]) -> None:
        for d in doc_ids:
            limits.doc_id(d)
        with self.lock:
            self._meta()
            self._commit(None, self._ids(doc_ids))

    def sync_delta(self, upserts: list[dict], deletes: list[str], source_id: str | None = None, skip_unchanged: bool = True, if_manifest_digest: str | None = None, if_index_profile_hash: str | None = None, max_docs: int | None = None) -> dict:
        """Upserts and deletes as one commit under preconditions: {results, counts, digest}.

        Results: (doc_id, status, content_hash), skipped and unchanged upserts first, then indexed ones, then
        deletes. Nothing is written if a precondition fails.
        """
        caps = self.engine.config.batches
        if len(upserts) + len(deletes) > (max_docs or caps.max_docs) or sum(len(d["text"].encode()) for d in upserts) > caps.max_text_bytes:
            raise InvalidInput("batch is over its limits")
        if source_id is not None:
            limits.source_id(source_id)
        for d in deletes:
            limits.doc_id(d)
        if {d["doc_id"] for d in upserts} & set(deletes):
            raise InvalidInput("a document is both written and deleted")
        rows = self._rows(upserts, source_id)
        with self.lock:
            self._create()
            stored = self._read("documents", DOCUMENT, buckets=self._buckets_of([d["doc_id"] for d in upserts] + deletes))
            if if_index_profile_hash is not None and if_index_profile_hash != self.current_profile():
                raise Conflict("index profile is another")
            if if_manifest_digest is not None and if_manifest_digest != self.manifest_digest(source_id)[0]:
                raise Conflict("manifest has changed")
            judged = deltas.classify_upserts(rows, stored, self.current_profile(), skip_unchanged, source_id)
            status = {r["doc_id"]: (r["status"], r["content_hash"]) for r in judged.select("doc_id", "status", "content_hash").collect()}  # one batch
            dropped = deltas.classify_deletes(self._ids(deletes), stored, source_id)
            removed = {r["doc_id"]: r["status"] for r in dropped.collect()}  # one batch
            write = [d for d, (s, _) in status.items() if s == "indexed"]
            gone = [d for d, s in removed.items() if s == "deleted"]
            if write or gone:
                self._commit(rows.filter(F.col("doc_id").isin(write)) if write else None, self._ids(gone) if gone else None)
        order = {"skipped_scope_mismatch": 0, "unchanged": 0, "indexed": 1}
        results = [{"doc_id": d, "status": s, "content_hash": h} for d, (s, h) in sorted(status.items(), key=lambda x: order[x[1][0]])]
        results += [{"doc_id": d, "status": removed[d], "content_hash": None} for d in dict.fromkeys(deletes)]
        counts = {s: sum(r["status"] == s for r in results) for s in ("indexed", "unchanged", "deleted", "not_found", "skipped_scope_mismatch")}
        return {"results": results, "counts": counts, "digest": self.manifest_digest(source_id)[0]}

    # -- reading ---------------------------------------------------------------------------------

    def fetch_doc(self, doc_id: str) -> dict:
        row = self._read("documents", DOCUMENT, buckets=self._buckets_of([limits.doc_id(doc_id)])).filter(F.col("doc_id") == doc_id).first()
        if row is None:
            raise UnknownDocument(doc_id)
        return {"doc_id": row["doc_id"], "text": row["text"], "metadata": {k: json.loads(v) for k, v in (row["metadata"] or {}).items() if k != limits.RESERVED_KEY}, "created_at": row["created_at"]}

    def fingerprint(self, doc_id: str) -> dict | None:
        row = self._read("documents", DOCUMENT, buckets=self._buckets_of([doc_id])).filter(F.col("doc_id") == doc_id).select("content_hash", "index_profile_hash", "source_id").first()
        return row.asDict() if row else None

    def stats(self) -> dict:
        """Documents, chunks, tokens and bytes on disk."""
        buckets = self._snapshot()["buckets"]
        where = [f"{self.path}/{x['folder']}/{kind}/b={b}" for b, i in buckets.items() for x in i["layers"] for kind in ("documents", "chunks", "postings", "gone") if x[kind]]
        return {k: sum(i[k] for i in buckets.values()) for k in ("documents", "chunks", "tokens")} | {"disk_bytes": sum(files.size(self.spark, w) for w in where)}

    def manifest_digest(self, source_id: str | None = None, prefix: str | None = None) -> tuple[str, int]:
        entries = deltas.manifest_entries(deltas.in_scope(self.documents(), source_id, prefix), self.current_profile())
        row = deltas.manifest_digest(entries).first()
        return row["digest"], row["total_count"]

    def manifest(self, profile: str | None = None, source_id: str | None = None, prefix: str | None = None, limit: int | None = None, cursor: str | None = None) -> dict:
        """A page of fingerprints with the digest and count of the whole scope."""
        if prefix is not None:
            limits.id_prefix(prefix)
        if cursor is not None:
            limits.id_prefix(cursor)
        entries = deltas.manifest_entries(deltas.in_scope(self.documents(), source_id, prefix), profile or self.current_profile())
        page, n = deltas.manifest_page(entries, limit, cursor)
        rows = [r.asDict() for r in page.collect()]  # a page
        digest, total = self.manifest_digest(source_id, prefix)
        return {"entries": rows[:n], "next_cursor": rows[n - 1]["doc_id"] if len(rows) > n else None, "total_count": total, "digest": digest}

    def corpus_stats(self) -> DataFrame:
        buckets = self._snapshot()["buckets"].values()
        chunks, terms = sum(b["chunks"] for b in buckets), sum(b["terms"] for b in buckets)
        return self.spark.createDataFrame([(chunks, terms / chunks if chunks else 0.0)], "n_chunks bigint, avgdl double")

    def search(self, query: str, top_k: int = 16, filter: search.SearchFilter | None = None, mode: str = "post", exclude: list[str] | None = None, dense_alpha: float = 1.0, query_vector: list[float] | None = None, syntax: bool = False) -> dict:
        """{hits, hint}: the best chunks. A collection that does not exist has no hits and a hint; it is not
        made. ``syntax`` reads the query as a boolean one."""
        limits.query(query)
        limits.alpha(dense_alpha)
        if not self.exists():
            return {"hits": [], "hint": self.engine.missing_hint(self.name)}
        if dense_alpha < 1 and query_vector is None:
            if self.encoder is None:
                raise InvalidQuery("dense_alpha under 1 needs a query vector or an encoder")
            query_vector = self.encoder.encode([query], "query")[0]
        k = limits.top_k(top_k)
        hits = self._hits(query, k, filter, mode, exclude, dense_alpha, query_vector, syntax)
        top = hits.orderBy("rank").collect()  # top k
        if not top:
            return {"hits": [], "hint": None}
        found = {r["doc_id"] for r in top}
        own = lambda kind, schema: self._read(kind, schema, buckets=self._buckets_of(sorted(found))).filter(F.col("doc_id").isin(sorted(found)))
        ranked = self.spark.createDataFrame(top, hits.schema)
        rows = ranked.join(own("chunks", CHUNK).drop("embedding"), ["doc_id", "chunk_idx"]).join(own("documents", DOCUMENT).select("doc_id", "metadata"), "doc_id", "left").orderBy("rank").collect()  # top k
        return {"hits": [{"doc_id": r["doc_id"], "chunk_idx": r["chunk_idx"], "score": r["score"], "raw_score": r["raw_score"], "snippet": r["chunk_text"], "char_start": r["char_start"], "char_end": r["char_end"], "byte_start": r["byte_start"], "byte_end": r["byte_end"], "metadata": {k: json.loads(v) for k, v in (r["metadata"] or {}).items()}} for r in rows], "hint": None}

    def _hits(self, query, k, filter, mode, exclude, alpha, vector, syntax) -> DataFrame:
        """Ranked hits of one query (query_id is empty)."""
        if mode not in ("post", "pre"):
            raise InvalidQuery(f"filter mode {mode!r} is neither post nor pre")
        queries = self.spark.createDataFrame([("", query)], "query_id string, query_text string")
        posts, stats = self.postings(), self.corpus_stats()
        if syntax:
            scored = query_syntax.boolean_search(self.spark, query, self.chunks(), posts, stats).withColumn("query_id", F.lit(""))
        else:
            scored = search.bm25_many(queries, posts, stats)
        where = filter.condition() if filter is not None and filter.active() else None
        allowed = self.documents().filter(where).select("doc_id") if where is not None else None
        if allowed is not None and mode == "pre":
            scored = scored.join(allowed, "doc_id", "left_semi")
        after = (allowed is not None and mode == "post") or bool(exclude) or alpha < 1
        pool = search.top_candidates(scored, limits.fetch_limit(k, after))
        if allowed is not None and mode == "post":
            pool = pool.join(allowed, "doc_id", "left_semi")
        if exclude:
            pool = pool.join(self.spark.createDataFrame([(d,) for d in exclude], "doc_id string"), "doc_id", "left_anti")
        order = [F.col("rank")]
        if alpha < 1:
            asked = F.array(*[F.lit(float(x)) for x in vector])
            vectors = self.chunks().select("doc_id", "chunk_idx", F.col("embedding").alias("_d"))
            pool = pool.join(vectors, ["doc_id", "chunk_idx"], "left")
            pool = pool.withColumn("score", F.round(alpha * F.col("score") + (1 - alpha) * search.cosine_unit(asked, F.col("_d")), search.BLEND_PLACES)).drop("_d")
            order = [F.col("score").desc(), F.col("rank")]
        return search.cut_and_rank(pool, k, order)

    # -- rounds ----------------------------------------------------------------------------------

    def search_iterative(self, query: str, session_id: str | None = None, top_k: int = 16) -> dict:
        """Search that leaves out what a session has seen: {session_id, round, hits, exhausted}."""
        session = self.engine.sessions.take(session_id, self.name)
        found = self.search(query, top_k, exclude=sorted(session["seen"]) or None)
        session["seen"] |= {h["doc_id"] for h in found["hits"]}
        session["round"] += 1
        self.engine.sessions.store(session)
        return {"session_id": session["id"], "round": session["round"], "hits": found["hits"], "exhausted": not found["hits"]}

    def interleave_round(self, query: str, state: dict | None = None, knobs: rounds.Knobs = rounds.Knobs(), filter: search.SearchFilter | None = None, dense_alpha: float = 1.0, query_vector: list[float] | None = None) -> dict:
        """One bounded round: {round, injected, state, stats, stop, hits}. At a limit nothing runs and the
        state comes back as it was."""
        limits.query(query)
        knobs = knobs.clamped()
        before = rounds.RoundState.resolve(state)
        reason = rounds.stop_reason(before, knobs, already=True)
        if reason:
            stop = {"hard_stop": True, "exhausted": True, "exhausted_2_rounds": before.empty_rounds >= 2, "low_gain_2_rounds": before.low_gain_rounds >= 2, "reason": reason}
            return {"round": before.round, "injected": [], "state": before.to_dict(), "stats": None, "stop": stop, "hits": []}
        hits = self._hits(query, knobs.top_k, filter, "post", None, dense_alpha, query_vector, False)
        docs = self.documents()
        seen = self.spark.createDataFrame([(d,) for d in before.seen_doc_ids], "doc_id string") if before.seen_doc_ids else None
        digests = docs.filter(grouping.is_digest(F.col("doc_id"), F.get_json_object(F.concat(F.lit('{"k":'), F.try_element_at("metadata", F.lit("kind")), F.lit("}")), "$.k")))
        digests = digests.select("doc_id", F.from_json(F.try_element_at("metadata", F.lit("member_ids")), "array<string>").alias("member_ids"))
        used = self.spark.createDataFrame([("", before.used_chars_total)], "query_id string, used bigint")
        injected, stats = rounds.round_many(hits, docs, knobs, seen, digests, used)
        placed = [r.asDict() for r in injected.orderBy("rank").collect()]  # fetch_top_n documents
        row = stats.first()
        figures = row.asDict() if row else {"candidates": 0, "dedup_skipped_count": 0, "supersede_skipped_count": 0, "budget_skipped_count": 0, "truncated_docs": 0, "injected": 0, "new_chars": 0, "used_chars_total": before.used_chars_total, "marginal_gain": 0.0, "dedup_ratio": 0.0}
        after, stop = rounds.next_state(before, knobs, [p["doc_id"] for p in placed], figures["new_chars"], figures["marginal_gain"])
        figures["remaining_chars"] = max(0, knobs.max_total_chars - after.used_chars_total)
        return {"round": after.round, "injected": placed, "state": after.to_dict(), "stats": figures, "stop": stop, "hits": [r.asDict() for r in hits.orderBy("rank").collect()]}

    # -- memory ----------------------------------------------------------------------------------

    def remember(self, text: str, kind: str = "fact", source_id: str | None = None, doc_id: str | None = None, metadata: dict | None = None, force: bool = False) -> dict:
        """Keep a text as a capsule, unless it says too little or is kept already."""
        limits.text(text)
        kind = MemoryKind.parse(kind).value
        extra = limits.metadata(metadata)
        if doc_id is not None:
            limits.doc_id(doc_id)
        settings = self.engine.config.memory
        request = self.spark.createDataFrame([(0, text, doc_id, force)], "request_id bigint, text string, explicit_id string, forced boolean")
        stored = self.documents().filter("raw_hash is not null").select("doc_id", "raw_hash") if self.exists() else self.spark.createDataFrame([], "doc_id string, raw_hash string")
        out = remember_batch(request, stored, settings.min_signal_chars, settings.detail_chars).first().asDict()
        status = None
        if out["low_signal_reason"] is None or out["forced"]:
            out["low_signal_reason"] = None
            if not out["deduplicated"]:
                out["doc_id"] = doc_id or f"mem-{uuid.uuid4().hex}"
                now = datetime.now(timezone.utc)
                detail = min(len(sanitize(text)), settings.detail_chars)
                meta = extra | {"kind": kind, "created_at": now.isoformat(), "source": "agent", "index_text_version": 2, "rich": True, "detail_chars": detail}
                if source_id is not None:
                    meta["source_id"] = source_id
                done = self.sync_delta([{"doc_id": out["doc_id"], "text": out["capsule_text"], "metadata": meta, "created_at": now, "raw_hash": out["raw_hash"]}], [], source_id, skip_unchanged=False)
                status = done["results"][0]["status"]
        return out | {"status": status}

    def forget(self, doc_id: str | None = None, source_id: str | None = None) -> int:
        """Delete one document, or all of a source; gives how many there were."""
        if (doc_id is None) == (source_id is None):
            raise InvalidInput("forget needs a document or a source, one of them")
        if doc_id is not None:
            return self.sync_delta([], [doc_id])["counts"]["deleted"]
        limits.source_id(source_id)
        with self.lock:
            return self._commit(None, self.documents().filter(F.col("source_id") == source_id).select("doc_id"))["gone"]

    # -- digests ---------------------------------------------------------------------------------

    def _digests(self) -> DataFrame:
        get = lambda k: F.try_element_at("metadata", F.lit(k))
        return self.documents().filter(F.startswith("doc_id", F.lit(grouping.DIGEST_PREFIX))).select("doc_id", F.get_json_object(F.concat(F.lit('{"k":'), get("digest_key"), F.lit("}")), "$.k").alias("digest_key"), F.from_json(get("member_ids"), "array<string>").alias("member_ids"), get("member_count").cast("bigint").alias("member_count"), get("version").cast("bigint").alias("version"))

    def consolidate(self, session_key: str = "day", options: grouping.Options = grouping.Options(), backend=None) -> list[dict]:
        """Distil the groups worth it into digests; gives those written or refused."""
        value = F.get_json_object(F.concat(F.lit('{"k":'), F.try_element_at("metadata", F.lit(session_key)), F.lit("}")), "$.k")
        docs = self.documents().filter(~F.startswith("doc_id", F.lit(grouping.DIGEST_PREFIX))).select("doc_id", "text", F.coalesce(value, "doc_id").alias("session"), "created_at")
        digests = self._digests()
        chosen = [r.asDict() for r in grouping.select_candidates(docs, digests, options).collect()]  # max_candidates rows
        out = []
        for c in chosen:
            frame = self.spark.createDataFrame([(c["key"], c["doc_ids"])], "key string, doc_ids array<string>")
            texts = grouping.member_texts(frame, docs, options.max_member_chars)
            made = (grouping.concat_sentences(texts, options.digest_max_chars) if backend is None else grouping.distill_with(texts, backend, options.digest_max_chars)).first()
            out.append(self.commit_digest(c["key"], c["doc_ids"], made["text"] if made else "", options.digest_max_chars))
        return out

    def commit_digest(self, key: str, member_ids: list[str], text: str, most: int = 800) -> dict:
        """Write a digest, its text sanitised and cut; one of other documents under the same key is kept."""
        text = sanitize(text)[:most]
        if not text.strip():
            raise InvalidInput("empty digest text")
        doc_id = grouping.digest_id(key)
        old = self._digests().filter(F.col("doc_id") == doc_id).first()
        if old and old["member_ids"] and not set(old["member_ids"]) & set(member_ids):
            raise InvalidInput(f"{doc_id} is the digest of other documents")
        version = (old["version"] or 0) + 1 if old else 1
        self.index(doc_id, text, {"kind": "digest", "digest_key": key, "member_ids": member_ids, "member_count": len(member_ids), "version": version})
        return {"doc_id": doc_id, "key": key, "text": text, "member_ids": member_ids, "version": version}

    # -- folders ---------------------------------------------------------------------------------

    def sync_path(self, root: str, source_id: str, include: tuple[str, ...] | None = None, exclude: tuple[str, ...] = (), prune: bool = False, dry_run: bool = False) -> dict:
        """Bring the documents of a source up to a folder of files: {counts, unreadable}."""
        limits.source_id(source_id)
        settings = self.engine.config.folders
        found = materialise(read_folder(self.spark, root, tuple(include or settings.include), tuple(exclude or settings.exclude), settings.max_file_bytes, settings.max_files))
        unreadable = [r[0] for r in found.filter("not readable").select("doc_id").orderBy("doc_id").collect()]  # names, of max_files at most
        json_of = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1)
        about = F.create_map(*[x for k in ("created_at", "source", "ext", "dir") for x in (F.lit(k), json_of(k))])
        rows = self._table_rows(found.filter("readable").select("doc_id", "text", about.alias("metadata"), F.col("mtime").alias("created_at")), source_id)
        with self.lock:
            if not dry_run:
                self._create()
            stored = self.documents() if self.exists() else self.spark.createDataFrame([], DOCUMENT)
            gone = deltas.prune_set(deltas.in_scope(stored, source_id), found) if prune else self._ids([])
            if dry_run:
                seen = deltas.sync_preview(rows, deltas.in_scope(stored, source_id)).first()
                return {"counts": {"new": seen["new_files"], "changed": seen["changed_files"], "unchanged": seen["unchanged_files"], "pruned": gone.count()}, "unreadable": unreadable}
            judged = materialise(deltas.classify_upserts(rows, stored, self.current_profile(), True, source_id))
            gone = materialise(gone.select("doc_id"))
            total = deltas.outcome_counts(judged).first().asDict() | {"deleted": gone.count()}
            if total["indexed"] or total["deleted"]:
                self._commit(judged.filter("status = 'indexed'").drop("status") if total["indexed"] else None, gone)
        return {"counts": total, "unreadable": unreadable}

    def drop(self) -> bool:
        return self.engine.drop_collection(self.name)


class Sessions:
    """Search cursors in memory; one idle for longer than the limit is forgotten."""

    def __init__(self, ttl: float = 600.0, clock=time.monotonic):
        self.ttl, self.clock, self.kept, self.lock = ttl, clock, {}, threading.Lock()

    def _sweep(self) -> None:
        now = self.clock()
        for k in [k for k, s in self.kept.items() if now - s["touched"] > self.ttl]:
            del self.kept[k]

    def take(self, session_id: str | None, collection: str) -> dict:
        with self.lock:
            self._sweep()
            if session_id is None:
                return {"id": uuid.uuid4().hex, "collection": collection, "seen": set(), "round": 0, "touched": self.clock()}
            session = self.kept.get(session_id)
            if session is None:
                raise InvalidInput("unknown or expired session")
            if session["collection"] != collection:
                raise InvalidInput("session belongs to another collection")
            return dict(session, seen=set(session["seen"]))

    def store(self, session: dict) -> None:
        with self.lock:
            self.kept[session["id"]] = dict(session, touched=self.clock())

    def drop(self, session_id: str) -> bool:
        with self.lock:
            return self.kept.pop(session_id, None) is not None


class Engine:
    """All collections below one folder."""

    def __init__(self, spark: SparkSession, root: str | None = None, config: Config | None = None, encoder: Encoder | None = None):
        self.spark, self.config, self.encoder = spark, config or load(), encoder
        self.root = (root or self.config.root).rstrip("/")
        files.make_folder(spark, self.root)
        self.sessions = Sessions(self.config.session_ttl_s)
        self._locks: dict[str, threading.RLock] = {}
        self._guard = threading.Lock()

    def lock_of(self, name: str) -> threading.RLock:
        with self._guard:
            return self._locks.setdefault(name, threading.RLock())

    def collection(self, name: str | None = None) -> Collection:
        return Collection(self, name or self.config.memory.default_collection)

    def list_collections(self) -> list[str]:
        return [n for n in files.names(self.spark, self.root) if not n.startswith(".") and files.exists(self.spark, f"{self.root}/{n}/_meta.json")]

    def drop_collection(self, name: str) -> bool:
        path, trash = f"{self.root}/{limits.collection_name(name)}", f"{self.root}/.trash-{uuid.uuid4().hex}"
        with self.lock_of(name):
            if not files.rename(self.spark, path, trash):
                return False
            files.delete(self.spark, trash)
            return True

    def drop_session(self, session_id: str) -> bool:
        return self.sessions.drop(session_id)

    def missing_hint(self, name: str) -> str:
        names = self.list_collections()
        if not names:
            return f"collection {name} does not exist; there are none yet"
        more = f" (+{len(names) - 20} more)" if len(names) > 20 else ""
        return f"collection {name} does not exist; known: {', '.join(names[:20])}{more}"
