import numpy as np
import pytest

from loamstone.llm import sentences as se


@pytest.fixture(scope="module")
def model(spark):
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("kind in ('note', 'turn', 'capsule', 'digest')")
    return se.train(se._prose(prose, "turn"))


CASES = [
    ("The first one works. The second fails!", 2),
    ("See Fig. 31 and Sec. 4.2 of the notes, i.e. the part on offsets. The rest follows.", 2),
    ("the job ran at 4 a.m. and ended around noon. The rest was fine.", 2),
    ("Version 3.14 beats 2.71 by 0.5 percent.", 1),
    ('The ticket asked "Why is selitakoki stale?" and was closed.', 1),
    ('The note on x says "all clear." The next run failed.', 2),
    ("Wait... the queue was empty! Nobody noticed.", 2),
    ("索引器检查了空白页。为什么又失败了？夜里很安静。", 3),
    ("当番は「再試行しない。鍵がある。」と書いた。次の日。", 2),
    ("संचालक ने छाप के स्तंभ को जाँचा। कतार ने मापा।", 2),
    ("A heading / alone\n\nThen a line\nwrapped here. The rest.", 3),
    ("", 0),
    (" \n\n ", 0),
]


@pytest.mark.parametrize("text,n", CASES)
def test_cases(model, text, n):
    spans = model.cut(text, False)
    assert len(spans) == n, [text[a:b] for a, b in spans]


def test_spans_cover_all_but_white_space(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in se.split_sentences(docs, model).collect():
        got.setdefault(r["doc_id"], []).append((r["s_start"], r["s_end"]))
    for i, t in text.items():
        spans = sorted(got.get(i, []))
        assert "".join("".join(t[a:b].split()) for a, b in spans) == "".join(t.split())
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_lines_end_sentences_in_turns_only(model):
    t = "one line without a mark\nanother line. The next one"
    assert len(model.cut(t, True)) == 3 and len(model.cut(t, False)) == 2


def test_thai_spaces(model):
    t = "ตัววางแผนวัดข้อความ42ชิ้นบนเครื่องสำรอง ตอนนี้ผู้ใช้ของborenorinanทุกคนข้ามค่าที่ขัดแย้งกัน"
    assert len(model.cut(t, False)) == 2


def test_held_out_reliable_boundaries(spark, model):
    """Paragraphs joined by a space must come apart again where a mark ended them."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("kind = 'note' and lang in ('en', 'it', 'es', 'fr', 'de', 'ru')")
    right = total = 0
    for r in docs.collect():
        parts = [" ".join(p.split()) for p in r["text"].split("\n\n") if p.strip()]
        parts = [p for p in parts if p[-1] in ".!?"]
        joined, edges = " ".join(parts), set(np.cumsum([len(p) + 1 for p in parts])[:-1].tolist() if parts else [])
        starts = {a for a, _ in model.cut(joined, False)}
        right, total = right + len(edges & starts), total + len(edges)
    assert total > 50 and right / total > 0.98


def test_untrained_and_hard_inputs(spark):
    df = spark.createDataFrame([(1, "One. Two.", "note", 5), (1, "One. Two.", "note", 5), (2, None, "note", 5), (None, "x.", "note", 5), (3, "", None, 5), (4, "word " * 50_000, None, 5)], "doc_id bigint, text string, kind string, s_start int")
    got = se.split_sentences(df).collect()
    assert {r["doc_id"] for r in got} == {1, 4}
    assert se.split_sentences(df.limit(0)).count() == 0
    assert len(se.fit_logistic(np.ones((4, 2)), np.array([1.0, 0, 1, 0]))) == 2


def test_every_count_is_used_whatever_workers_hold(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("kind in ('note', 'turn', 'capsule', 'digest')")
    prose = se._prose(docs, "turn")
    counts = prose.mapInArrow(se._statistics, "side string, key string, edge bigint, inner bigint").groupBy("side", "key").sum("edge", "inner").collect()
    whole = se.train(prose)
    for side, table in (("L", whole.left), ("R", whole.right)):
        assert table == {r["key"]: (r[2], r[3]) for r in counts if r["side"] == side} and min(map(sum, table.values())) == 1
    assert whole.rest is None
    want = sorted(map(tuple, se.split_sentences(docs, whole).collect()))
    monkeypatch.setattr(se, "HELD_KEYS", 7)
    few = se.train(prose)
    assert len(few.left) == len(few.right) == 7 and few.rest.count() == len(counts) - 14
    assert np.allclose(few.weights, whole.weights)
    assert sorted(map(tuple, se.split_sentences(docs, few).collect())) == want
    for r in se._with_rare(prose, few).collect():
        m = few.knowing(r["rare"])
        for block in se.blocks(r["text"], r["by_line"]):
            for c in se.candidates(r["text"], block):
                assert m.features(r["text"], block, *c) == whole.features(r["text"], block, *c)


def test_a_word_without_counts_is_unknown():
    model = se.Model({"zorbel .": (0, 60)}, {"known": (0, 60)}, 0.5, 0.1)
    assert model.dotted("zorbel", 60) == 0.0 and model.dotted("known", 60) == 1.0
    assert not model.reliable_inner("zorbel", "zorbel .", False)


def test_neighbours_are_read_to_their_ends():
    word = "x" * 300
    text = f"so {word}. {word}y then"
    a = text.index(".")
    assert se.left_key(text, a, a + 1, 0) == (word, f"{word} .") and se.right_key(text, a + 2, len(text)) == f"{word}y"
    assert se.left_key("a" + " " * 500 + ".", 501, 502, 0)[0] == "a"
    assert se.right_key('"' * 100 + "z", 0, 101) == "z"


def test_the_sample_is_bounded_whatever_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("kind in ('note', 'turn', 'capsule', 'digest')")
    prose = se._prose(docs, "turn")
    model = se.train(prose, 200)
    chosen, below = se._sampled(prose, model, 100)
    shared = spark.sparkContext.broadcast(model)
    written = se._with_rare(chosen, model).mapInArrow(lambda it: se._labelled(it, shared, below), "h bigint, label int, x array<double>").groupBy("label").count().collect()
    assert all(60 < r["count"] < 1200 for r in written) and len(written) == 2 and chosen.count() < prose.count() / 2
    assert len(model.cut("The first one works. The second fails!", False)) == 2
