import json
import os
import threading
from datetime import datetime, timedelta, timezone

import pytest

from loamstone.collection import Engine, Sessions
from loamstone.config import Batches, Config
from loamstone.encoders import FirstWordEncoder
from loamstone.errors import Conflict, InvalidInput, InvalidQuery, SchemaError, UnknownCollection, UnknownDocument
from loamstone.operators.consolidate import Options, digest_id
from loamstone.operators.interleave import Knobs
from loamstone.operators.search import SearchFilter
from loamstone.streaming.sync import event_windows, search_sessions, stream_into

LONG = "The deployment of the billing service was moved to Monday because the database migration took longer than expected."


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "c"), Config(buckets=2))


def test_index_search_fetch_delete(engine):
    c = engine.collection("docs")
    c.index_batch([{"doc_id": "d1", "text": "il gatto nero dorme sul divano rosso", "metadata": {"n": 1}}, {"doc_id": "d2", "text": "configurazione XML del server"}])
    top = c.search("gatto")["hits"][0]
    assert top["doc_id"] == "d1" and 0 < top["score"] <= 1 and top["metadata"] == {"n": 1}
    assert c.fetch_doc("d1")["text"].startswith("il gatto")
    c.index("d1", "one two three four five")
    assert c.stats() | {"disk_bytes": 0} == {"documents": 2, "chunks": 2, "tokens": 9, "disk_bytes": 0}
    c.delete("d1")
    c.delete("d1")
    with pytest.raises(UnknownDocument):
        c.fetch_doc("d1")
    c.delete("d2")
    assert c.stats() | {"disk_bytes": 0} == {"documents": 0, "chunks": 0, "tokens": 0, "disk_bytes": 0}
    assert c.search("gatto")["hits"] == []
    assert c.compact() >= 0


def test_unknown_collection_gets_a_hint_and_is_not_made(engine):
    for i in range(23):
        os.makedirs(f"{engine.root}/n{i:02d}")
        open(f"{engine.root}/n{i:02d}/_meta.json", "w").write('{"schema_version": 1}')
    out = engine.collection("absent").search("x")
    assert out["hits"] == [] and "(+3 more)" in out["hint"] and "absent" not in engine.list_collections()
    with pytest.raises(UnknownCollection):
        engine.collection("absent").stats()


def test_filters_exclusions_and_syntax(engine):
    c = engine.collection("docs")
    c.index_batch([{"doc_id": f"d{i}", "text": "alpha bravo charlie", "metadata": {"kind": k}} for i, k in enumerate(["turn", "loop", "turn", "conf", "turn"])])
    ids = lambda **kw: [h["doc_id"] for h in c.search("alpha", 5, **kw)["hits"]]
    assert ids(exclude=["d0", "d2"]) == ["d1", "d3", "d4"]
    for mode in ("post", "pre"):
        assert ids(filter=SearchFilter(where_eq={"kind": "turn"}), mode=mode) == ["d0", "d2", "d4"]
        assert ids(filter=SearchFilter(where_in={"kind": ["loop", "conf"]}), mode=mode) == ["d1", "d3"]
    c.index("p", "bravo alpha delta")
    found = lambda q: sorted(h["doc_id"] for h in c.search(q, syntax=True)["hits"])
    assert found('"bravo alpha"') == ["p"] and found("alpha -charlie") == ["p"] and found("+delta alpha") == ["p"]
    assert found("delta AND NOT charlie") == ["p"] and found("(delta OR echo) AND alpha") == ["p"] and len(found("delta alpha^2")) == 6
    for bad in ("(alpha", "alpha)", "alpha AND", '""', "+"):
        with pytest.raises(InvalidQuery):
            c.search(bad, syntax=True)
    for bad in (lambda: c.search(" "), lambda: c.search("alpha", dense_alpha=0.5), lambda: c.search("alpha", dense_alpha=2)):
        with pytest.raises(InvalidQuery):
            bad()


def test_hybrid_prefers_the_like_vector(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "c"), Config(buckets=1), FirstWordEncoder(16))
    c = e.collection("docs")
    c.index_batch([{"doc_id": "a", "text": "first alpha bravo charlie"}, {"doc_id": "b", "text": "delta alpha bravo charlie"}])
    assert c.search("alpha", dense_alpha=0.2, query_vector=e.encoder.encode(["first"])[0])["hits"][0]["doc_id"] == "a"
    assert c.search("alpha", dense_alpha=0.5, query_vector=[1.0, 0.0])["hits"][0]["score"] == 0.75  # another dimension counts 0.5


def test_delta_statuses_scopes_and_preconditions(engine):
    c = engine.collection("docs")
    doc = lambda i, t: {"doc_id": i, "text": t}
    counts = lambda *a, **kw: {k: v for k, v in c.sync_delta(*a, **kw)["counts"].items() if v}
    assert counts([doc("a", "hello world")], [], "A") == {"indexed": 1}
    assert counts([doc("a", "hello world")], [], "A") == {"unchanged": 1}
    assert counts([doc("a", "hello there")], [], "A") == {"indexed": 1}
    assert counts([doc("a", "by B")], ["zz"], "B") == {"skipped_scope_mismatch": 1, "not_found": 1}
    assert counts([], ["a"], "B") == {"skipped_scope_mismatch": 1}
    before = c.manifest_digest()
    for kw in ({"if_manifest_digest": "stale"}, {"if_index_profile_hash": "other"}):
        with pytest.raises(Conflict):
            c.sync_delta([doc("n", "new")], [], **kw)
    assert c.manifest_digest() == before
    assert counts([doc("n", "new")], ["a"], if_manifest_digest=before[0]) == {"indexed": 1, "deleted": 1}
    with pytest.raises(InvalidInput):
        c.sync_delta([doc("x", "t")], ["x"])
    with pytest.raises(InvalidInput):
        c.sync_delta([doc("x", "t"), doc("y", "t")], [], max_docs=1)
    assert c.fingerprint("n")["source_id"] is None and c.fingerprint("nope") is None


def test_manifest_pages(engine):
    c = engine.collection("docs")
    c.index_batch([{"doc_id": i, "text": i} for i in ("p/a", "p/b", "q/c")])
    one = c.manifest(limit=2)
    two = c.manifest(limit=2, cursor=one["next_cursor"])
    assert [e["doc_id"] for e in one["entries"] + two["entries"]] == ["p/a", "p/b", "q/c"] and two["next_cursor"] is None
    assert one["digest"] == two["digest"] and one["total_count"] == 3
    assert c.manifest(prefix="p/")["total_count"] == 2 and c.manifest(source_id="none")["total_count"] == 0
    assert {e["hash_state"] for e in c.manifest("another")["entries"]} == {"profile_stale"}


def test_one_of_two_racing_syncs_commits(engine):
    c = engine.collection("docs")
    c.index("seed", "seed")
    digest, seen = c.manifest_digest()[0], []

    def sync(i):
        try:
            engine.collection("docs").sync_delta([{"doc_id": f"r{i}", "text": "t"}], [], if_manifest_digest=digest)
            seen.append("ok")
        except Conflict:
            seen.append("conflict")

    threads = [threading.Thread(target=sync, args=(i,)) for i in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(seen) == ["conflict", "ok"]


def test_a_failed_commit_leaves_the_version_before(spark, tmp_path):
    class Broken(FirstWordEncoder):
        def encode(self, texts, kind="passage"):
            if any("boom" in t for t in texts):
                raise ValueError("boom")
            return super().encode(texts, kind)

    c = Engine(spark, str(tmp_path / "c"), Config(buckets=1), Broken(4)).collection("docs")
    c.index("a", "fine words")
    with pytest.raises(Exception):
        c.index_batch([{"doc_id": "a", "text": "other words"}, {"doc_id": "b", "text": "boom"}])
    assert c.fetch_doc("a")["text"] == "fine words" and c.stats()["documents"] == 1


def test_schema_versions(engine):
    c = engine.collection("docs")
    c.index("a", "text")
    for content in ('{"schema_version": 9999}', "{broken"):
        open(f"{c.path}/_meta.json", "w").write(content)
        with pytest.raises(SchemaError):
            c.stats()


def test_drop(engine):
    engine.collection("docs").index("a", "text")
    assert engine.list_collections() == ["docs"]
    assert engine.drop_collection("docs") and not engine.drop_collection("docs") and engine.list_collections() == []
    with pytest.raises(InvalidInput):
        engine.drop_collection("../x")


def test_rounds(engine):
    c = engine.collection("docs")
    c.index_batch([{"doc_id": i, "text": f"interleave memory note {i}"} for i in "abc"])
    knobs = Knobs(top_k=8, fetch_top_n=2)
    one = c.interleave_round("interleave memory", None, knobs)
    assert one["round"] == 1 and len(one["injected"]) == 2 and one["stats"]["marginal_gain"] == 1.0 and one["stats"]["dedup_skipped_count"] == 0
    two = c.interleave_round("interleave memory", one["state"], knobs)
    assert two["stats"]["dedup_skipped_count"] == 2 and not {i["doc_id"] for i in two["injected"]} & {i["doc_id"] for i in one["injected"]}
    none = c.interleave_round("nothing like it", two["state"], knobs)
    again = c.interleave_round("nothing like it", none["state"], knobs)
    assert none["stop"]["exhausted"] and not none["stop"]["exhausted_2_rounds"] and again["stop"]["exhausted_2_rounds"]
    cut = c.interleave_round("interleave", None, Knobs(max_chars_per_doc=5, fetch_top_n=1))
    assert cut["injected"][0]["chars"] == 5 and cut["injected"][0]["truncated"] and cut["stats"]["remaining_chars"] == 15_995
    total = c.interleave_round("interleave", None, Knobs(max_total_chars=6, fetch_top_n=2))
    assert (len(total["injected"]), total["stats"]["budget_skipped_count"], total["stop"]["reason"]) == (1, 1, "max_total_chars reached")
    assert c.interleave_round("interleave", total["state"], Knobs(max_total_chars=6))["stop"]["reason"] == "max_total_chars already reached"
    last = c.interleave_round("interleave", None, Knobs(max_rounds=1))
    assert last["stop"]["reason"] == "max_rounds reached"
    handmade = c.interleave_round("interleave", {"round": 7, "seen_doc_ids": ["a", "c"]}, Knobs(max_rounds=9))
    assert handmade["round"] == 8 and [i["doc_id"] for i in handmade["injected"]] == ["b"]
    for bad in ({"surprise": 1}, {"schema_version": 2}, {"round": -1}):
        with pytest.raises(InvalidInput):
            c.interleave_round("interleave", bad)


def test_digest_covers_its_members(engine):
    c = engine.collection("docs")
    c.index_batch([{"doc_id": i, "text": f"cover story {i}"} for i in ("m0", "m1", "fresh1")])
    c.commit_digest("cover+story", ["m0", "m1"], "cover story of both")
    out = c.interleave_round("cover story", None, Knobs(fetch_top_n=8))
    assert {i["doc_id"] for i in out["injected"]} == {digest_id("cover+story"), "fresh1"} and out["stats"]["supersede_skipped_count"] == 2


def test_iterative_search_and_sessions(engine):
    c = engine.collection("docs")
    c.index_batch([{"doc_id": i, "text": "alpha"} for i in "abc"])
    one = c.search_iterative("alpha", top_k=2)
    two = c.search_iterative("alpha", one["session_id"], 2)
    assert {h["doc_id"] for h in one["hits"] + two["hits"]} == set("abc") and two["round"] == 2
    assert c.search_iterative("alpha", one["session_id"])["exhausted"]
    with pytest.raises(InvalidInput):
        engine.collection("other").search_iterative("alpha", one["session_id"])
    assert engine.drop_session(one["session_id"]) and not engine.drop_session(one["session_id"])
    clock = [0.0]
    s = Sessions(10, lambda: clock[0])
    x = s.take(None, "c")
    s.store(x)
    clock[0] = 11
    with pytest.raises(InvalidInput):
        s.take(x["id"], "c")


def test_remember_and_forget(engine):
    c = engine.collection()
    short = c.remember("too short")
    assert short["low_signal_reason"].startswith("text too short (9 chars") and short["doc_id"] is None
    assert c.remember("too short", force=True)["forced"]
    first = c.remember(LONG, source_id="sess-A", metadata={"kind": "mine", "topic": "x"})
    again = c.remember(LONG)
    assert again["deduplicated"] and again["existing_doc_id"] == first["doc_id"]
    kept = c.fetch_doc(first["doc_id"])
    assert kept["metadata"]["kind"] == "fact" and kept["metadata"]["topic"] == "x" and kept["text"].startswith("summary: ")
    assert c.remember(LONG, "Episode ", doc_id="mine")["doc_id"] == "mine" and c.fetch_doc("mine")["metadata"]["kind"] == "episode"
    assert c.remember(LONG + " B", source_id="sess-B", doc_id=first["doc_id"])["status"] == "skipped_scope_mismatch"
    c.remember(LONG + " second", source_id="sess-A")
    assert c.forget(source_id="sess-A") == 2 and c.forget(doc_id="mine") == 1 and c.forget(doc_id="mine") == 0
    for bad in ({}, {"doc_id": "a", "source_id": "b"}):
        with pytest.raises(InvalidInput):
            c.forget(**bad)
    with pytest.raises(InvalidInput):
        c.remember(LONG, "preferense")


def test_no_secret_is_kept(engine):
    c = engine.collection()
    out = c.remember(f"{LONG} The key is api_key=verysecretvalue123 for the staging system.")
    assert "verysecret" not in json.dumps(c.fetch_doc(out["doc_id"])["text"]) and "[redacted]" in out["capsule_text"]


def test_consolidation(engine):
    c = engine.collection("notes")
    day = datetime(2031, 1, 1, tzinfo=timezone.utc)
    c.index_batch([{"doc_id": f"c{i}", "text": f"marathon training plan tempo run number{i}. shared sentence here", "metadata": {"day": str(i)}, "created_at": day + timedelta(days=i)} for i in (1, 2, 3)] + [{"doc_id": "c4", "text": "teapot porcelain"}])
    opts = Options(min_shared_terms=2, max_term_df=10)
    made = c.consolidate(options=opts)
    assert [m["member_ids"] for m in made] == [["c1", "c2", "c3"]] and made[0]["version"] == 1 and made[0]["text"].count("shared sentence") == 1
    assert c.consolidate(options=opts) == []
    c.index_batch([{"doc_id": f"c{i}", "text": f"marathon training plan tempo run number{i}", "metadata": {"day": str(i)}, "created_at": day + timedelta(days=i)} for i in (5, 6, 7)])
    assert [m["version"] for m in c.consolidate(options=opts, backend=lambda key, texts, most: " / ".join(texts)[:most])] == [2]
    with pytest.raises(InvalidInput, match="digest of other documents"):
        c.commit_digest(made[0]["key"], ["zz"], "text")
    with pytest.raises(InvalidInput, match="empty"):
        c.commit_digest("k", ["a"], " ")


def test_sync_path(engine, tmp_path):
    root = tmp_path / "files"
    (root / "sub").mkdir(parents=True)
    for name, content in (("a.md", b"alpha"), ("sub/b.md", b"bravo"), ("ignore.log", b"nope"), ("bad.md", b"\xff\xfe\xff")):
        (root / name).write_bytes(content)
    os.symlink("/etc/hostname", root / "leak.md")
    c = engine.collection("files")
    preview = c.sync_path(str(root), "fs", ("**/*.md",), dry_run=True)
    assert preview["counts"]["new"] == 2 and preview["unreadable"] == ["bad.md"]
    assert c.sync_path(str(root), "fs", ("**/*.md",))["counts"]["indexed"] == 2
    assert c.fetch_doc("sub/b.md")["metadata"]["dir"] == "sub"
    assert c.sync_path(f"file://{root}", "fs", ("**/*.md",))["counts"]["unchanged"] == 2
    with pytest.raises(InvalidInput):
        c.sync_path(str(root / "nowhere"), "fs")
    (root / "a.md").unlink()
    assert c.sync_path(str(root), "fs", ("**/*.md",), prune=True)["counts"]["deleted"] == 1
    engine.config.folders.max_files = 0
    with pytest.raises(InvalidInput):
        c.sync_path(str(root), "fs", ("**/*.md",))


def test_batch_caps(spark, tmp_path):
    c = Engine(spark, str(tmp_path / "c"), Config(batches=Batches(1, 100))).collection("docs")
    with pytest.raises(InvalidInput):
        c.sync_delta([{"doc_id": "a", "text": "x" * 101}], [])


def test_stream_into_a_collection(spark, engine, tmp_path):
    src = str(tmp_path / "src")
    rows = [("a", "old words", {}, datetime(2031, 1, 1), 1), ("a", "new words", {}, datetime(2031, 1, 1), 2), ("b", "other", {}, datetime(2031, 1, 1), 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, metadata map<string,string>, created_at timestamp, n long")
    df.coalesce(1).write.parquet(src)
    c = engine.collection("stream")
    stream_into(c, spark.readStream.schema(df.schema).parquet(src), str(tmp_path / "cp"), "n").awaitTermination()
    assert c.fetch_doc("a")["text"] == "new words" and c.stats()["documents"] == 2


def test_search_sessions_end_when_idle(spark):
    at = datetime(2031, 1, 1, 12)
    rows = [("s", "a", at), ("s", "b", at + timedelta(minutes=5)), ("s", "a", at + timedelta(minutes=30)), ("t", "a", at)]
    out = search_sessions(spark.createDataFrame(rows, "session_id string, doc_id string, at timestamp")).collect()
    assert sorted((r["session_id"], r["hits"], r["documents"]) for r in out) == [("s", 1, 1), ("s", 2, 2), ("t", 1, 1)]


def test_event_windows(spark):
    rows = [(datetime(2031, 1, 1, 12, m), "view", 1.5) for m in (0, 4, 6)]
    out = event_windows(spark.createDataFrame(rows, "ts timestamp, event_type string, value double")).collect()
    assert sorted((r["n"], r["total"]) for r in out) == [(1, 1.5), (2, 3.0)]


def test_a_commit_writes_its_own_documents_only_and_layers_are_merged(spark, tmp_path, monkeypatch):
    from loamstone import collection, files

    monkeypatch.setattr(collection, "MANY_LAYERS", 3)

    class Counting(FirstWordEncoder):
        seen = str(tmp_path / "seen")

        def encode(self, texts, kind="passage"):
            with open(self.seen, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().encode(texts, kind)

    c = Engine(spark, str(tmp_path / "c"), Config(buckets=1), Counting(4)).collection("docs")
    assert c.index_batch([{"doc_id": f"d{i}", "text": f"alpha number{i}"} for i in range(30)]) == 30
    first = c._snapshot()["buckets"]["0"]["layers"][0]["folder"]
    c.index("d3", "bravo")
    layers = c._snapshot()["buckets"]["0"]["layers"]
    assert [x["documents"] for x in layers] == [30, 1] and layers[1]["gone"] == 1 and layers[0]["folder"] == first
    assert {r["doc_id"] for r in spark.read.parquet(f"{c.path}/{layers[1]['folder']}/documents").collect()} == {"d3"}
    c.delete("d4")
    c.index("d4", "charlie again")
    assert len(c._snapshot()["buckets"]["0"]["layers"]) == 1  # merged
    assert open(Counting.seen).read().count("alpha number") == 30  # nothing is encoded again
    got = {r["doc_id"]: r["text"] for r in c.documents().collect()}
    assert got == {f"d{i}": f"alpha number{i}" for i in range(30)} | {"d3": "bravo", "d4": "charlie again"}
    assert c.stats() | {"disk_bytes": 0} == {"documents": 30, "chunks": 30, "tokens": 59, "disk_bytes": 0}
    assert c.corpus_stats().first()["n_chunks"] == 30 and [h["doc_id"] for h in c.search("charlie")["hits"]] == ["d4"]
    assert c.chunks().filter("embedding is null").count() == 0 and c.compact() >= 3 and c.stats()["documents"] == 30
    assert files.names(spark, c.path + "/nothing") == []


def test_buckets_are_those_of_the_engine(spark, tmp_path):
    c = Engine(spark, str(tmp_path / "c"), Config(buckets=7)).collection("docs")
    ids = [f"id/{i}-ü漢" for i in range(40)] + ["a", "b" * 100]
    c.index("a", "text")
    want = {str(r[0]) for r in c._ids(ids).select(c._bucket()).collect()}
    assert c._buckets_of(ids) == want and all(c._buckets_of([i]) <= want for i in ids)


def test_a_folder_and_a_batch_hash_alike(engine, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "naïve file.md").write_text("alpha \"quoted\"")
    c = engine.collection("files")
    c.sync_path(str(root), "fs")
    kept = c.fetch_doc("naïve file.md")
    again = c.sync_delta([{"doc_id": "naïve file.md", "text": kept["text"], "metadata": kept["metadata"]}], [], "fs")
    assert again["counts"]["unchanged"] == 1
