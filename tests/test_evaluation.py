import json

import pytest

from loamstone.operators import evaluation as ev
from loamstone.operators.components import connected_components
from loamstone.operators.consolidate import concat_sentences
from loamstone.operators.interleave import budgeted
from loamstone.sources import readers, sinks


def metrics(spark, ranked, rel, k=10, **kw):
    r = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(ranked)], "query_id string, doc_id string, rank int")
    j = spark.createDataFrame([("q", d) for d in rel], "query_id string, doc_id string")
    return ev.ranking_metrics(r, j, k, **kw).first()


def test_metrics(spark):
    assert metrics(spark, ["a", "b"], ["a", "b"])["ndcg"] == 1.0 and metrics(spark, ["x"], ["a"])["ndcg"] == 0.0
    assert metrics(spark, ["a"], ["a"])["mrr"] == 1.0 and metrics(spark, ["x", "y", "a"], ["a"])["mrr"] == pytest.approx(1 / 3, abs=1e-6) and metrics(spark, ["x"], ["a"])["mrr"] == 0
    assert metrics(spark, ["a", "b", "x"], ["a", "b", "c"])["recall"] == pytest.approx(2 / 3, abs=1e-6)
    assert metrics(spark, ["a"], ["a", "b"])["ndcg"] == 1.0 and metrics(spark, ["a"], ["a", "b"], clip=False)["ndcg"] < 1.0
    assert metrics(spark, [], ["a"]).asDict() == {"query_id": "q", "ndcg": 0.0, "mrr": 0.0, "recall": 0.0}


def test_nearest_rank(spark):
    v = spark.createDataFrame([(float(x),) for x in range(10, 101, 10)], "v double")
    assert tuple(ev.nearest_rank(v, "v", [50, 95]).first()) == (50.0, 100.0)


def test_token_f1(spark):
    rows = spark.createDataFrame([(1, "The red, red house!", "red house"), (2, "a the", "an"), (3, "x", None)], "id int, pred string, gold string")
    out = {r["id"]: (r["f1"], r["em"]) for r in ev.token_f1(rows).collect()}
    assert out[1] == (pytest.approx(0.8), False) and out[2] == (1.0, True)


def test_budget_window(spark):
    rows = [("q", d, i, "x" * n, 2) for i, (d, n) in enumerate(zip("abcd", (5, 9, 4, 7)))]
    df = spark.createDataFrame(rows, "query_id string, doc_id string, rank int, text string, used int")
    out = budgeted(df, 6, 14, 4).orderBy("rank").collect()
    assert [r["chars"] for r in out] == [5, 6, 1, 0] and [r["budget_skipped"] for r in out] == [False] * 3 + [True] and [r["truncated"] for r in out] == [False, True, True, False]


def test_digest_sentences(spark):
    t = spark.createDataFrame([("k", 0, "alpha beta gamma. shared sentence here"), ("k", 1, "Shared sentence HERE. delta epsilon")], "key string, pos int, text string")
    out = concat_sentences(t).first()["text"]
    assert out.lower().count("shared") == 1 and "delta" in out
    assert len(concat_sentences(t, 20).first()["text"]) <= 20


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    p = spark.createDataFrame([(i, 0.2, 0.2 + (i % 3) * 0.1) for i in range(90)], "id int, a double, b double")
    one, two = ev.paired_bootstrap(p, 200).first(), ev.paired_bootstrap(p, 200).first()
    assert one == two and one["low"] <= one["mean_delta"] <= one["high"]


def test_bootstrap_evaluates_its_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    p = spark.createDataFrame([(i, 0.2, 0.2 + (i % 3) * 0.1) for i in range(90)], "id int, a double, b double")
    ev.paired_bootstrap(p.mapInArrow(count, p.schema), 50).collect()
    assert seen.value == 90


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 10), (7, 7), (None, 1), *[(100, i) for i in range(101, 130)]]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {**{i: 1 for i in (1, 2, 3, 4)}, 10: 10, 11: 10, **{i: 100 for i in range(100, 130)}}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_beir(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i}", "text": f"t{i}"}) + "\n\n" for i in range(5)))
    (tmp_path / "queries.jsonl").write_text("".join(json.dumps({"_id": q, "text": q}) + "\n" for q in ("q1", "q2", "q3")))
    (tmp_path / "qrels/test.tsv").write_text("query-id\titer\tdoc-id\trel\nq1\t0\td4\t1\nq2\t0\td1\t0\nq3\t0\td0\t2\n")
    data = readers.read_beir(spark, str(tmp_path), max_queries=1, max_docs=2)
    assert [r[0] for r in data.queries.select("query_id").collect()] == ["q1"] and sorted(r["doc_id"] for r in data.corpus.collect()) == ["d0", "d1", "d4"]
    assert data.answers is None


def test_long_memory(spark, tmp_path):
    q = {"question_id": "q", "question_type": "t", "question": "?", "answer": 5, "question_date": "2023/01/02 x", "haystack_dates": ["2023/01/01 (Sun)", "bad"], "haystack_session_ids": ["s1", "s2"], "haystack_sessions": [[{"role": "user", "content": "hi"}], [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]], "answer_session_ids": ["s2"]}
    p = tmp_path / "q.json"
    p.write_text(json.dumps([q]))
    questions, turns = readers.read_long_memory(spark, str(p))
    rows = turns.orderBy("session_pos", "turn").collect()
    assert [r["text"] for r in rows] == ["hi", "a", "b"] and [r["is_gold"] for r in rows] == [False, True, True] and str(rows[0]["date"]) == "2023-01-01" and rows[1]["date"] is None
    assert questions.first()["answer"] == "5"


@pytest.mark.parametrize("glob,path,hit", [("**/*.md", "a.md", True), ("**/*.md", "x/y/a.md", True), ("*.md", "x/a.md", False), ("x/**", "x/y/z", True), ("a?.txt", "ab.txt", True), ("a?.txt", "a/.txt", False)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(readers.glob_pattern(glob), path)) == hit


def test_sinks(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 1
    sinks.write_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 2, "b": 1}


def test_gate_needs_capture_and_a_lead(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "answer string, full string, snippet string, oracle string")
    one = ev.ablation_gate(rows(("red fox", "a Red  fox", "none", "red fox"), ("x", None, None, None), (None, "a", "a", "a"))).first()
    assert (one["queries"], one["full_rate"], one["snippet_rate"], one["oracle_capture"], one["passed"]) == (3, pytest.approx(1 / 3, abs=1e-6), 0, 1, True)
    assert not ev.ablation_gate(rows(("a", "a", "a", "a"))).first()["passed"]
    assert not ev.ablation_gate(rows(("a", "a", "", "a"), ("b", "", "", "b"))).first()["passed"]
    empty = ev.ablation_gate(rows(("a", "a", "a", "a")).limit(0)).first()
    assert (empty["queries"], empty["oracle_capture"], empty["passed"]) == (0, 1, False)


def test_picks_move_up_and_digests_cover_their_members_sessions(spark):
    hits = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate(["a", "dig", "b", "c", "d"])], "query_id string, doc_id string, rank int")
    digests = spark.createDataFrame([("dig", ["b", "zz", None]), ("d", ["a"])], "doc_id string, member_ids array<string>")
    picks = lambda k: [r["doc_id"] for r in ev.evidence_picks(hits, digests, k).orderBy("rank").collect()]
    assert picks(3) == ["a", "dig", "c"] and picks(1) == ["a"] and picks(9) == ["dig", "c", "d"]
    sessions = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("zz", "s3"), ("c", "s4")], "doc_id string, session string")
    gold = spark.createDataFrame([("q", "s3"), ("q", "s4"), ("q", "s9")], "query_id string, session string")
    assert tuple(ev.expanded_coverage(hits, digests, sessions, gold, 3).first()) == ("q", 2, 1, 3)


def test_renderers(spark):
    rows = [("q", 2, "two", "2031-01-02", "s"), ("q", 1, "one", None, None), ("q", 5, "five", "2031-01-02", "s"), ("q", 3, "three", "2031-01-01", "t")]
    e = spark.createDataFrame(rows, "query_id string, rank int, text string, date string, session string")
    assert ev.render_memories(e).first()["rendered"] == "[memory 1] one\n\n[memory 2] two\n\n[memory 3] three\n\n[memory 4] five"
    assert ev.render_memories(e, True).first()["rendered"].startswith("[memory 1 — unknown date] one\n\n[memory 2 — 2031-01-02] two")
    assert ev.render_sessions(e).first()["rendered"] == "[session of 2031-01-01]\n- three\n\n[session of 2031-01-02]\n- two\n- five\n\n[session of unknown]\n- one"
    assert ev.render_memories(e.limit(0)).count() == ev.render_sessions(e.limit(0)).count() == 0
