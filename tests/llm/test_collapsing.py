import json
import unicodedata

import pytest

from loamstone.llm.collapsing import canonical, collapse_layouts, copies, read_fields


def groups(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], "doc_id string, capsule_text string" + ", keep_id string, name string" * bool(extra))
    out = collapse_layouts(df, "doc_id", "capsule_text").collect()
    return {r["copy_id"]: (r["keep_id"], r["copies"]) for r in out}


def test_canonical_form():
    same = ["Café au lait", "CAFÉ  AU\nLAIT!", unicodedata.normalize("NFD", "café—au lait"), "Ｃafé au lait"]
    assert len({canonical(s) for s in same}) == 1
    assert canonical("cafe au lait") != canonical("café au lait") and canonical("Straße 5") == canonical("STRASSE 5") != canonical("Strasse 6")


@pytest.mark.parametrize(
    "text",
    ['{"a_b": 1, "c": "x y"}', '{\n "C": "X Y",\n "A-B": "1"\n}', "a_b=1; c=x y", "a b: 1 | c: x y;", "c:  x y\na_b:  1.", "- C = x y\n- A B = 1", "a_b: 1, c: x y"],
)
def test_notations_of_one_list(spark, text):
    got = groups(spark, [("k0", "a_b=1; c=x y"), ("k1", text)])
    assert got["k1"] == ("k0", 2)


def test_prose_with_colons_is_no_list():
    assert read_fields("Under load the indexer copied the file from: the other side") is None
    assert read_fields("He said: wait. Then nothing happened, which was odd: nobody called") is None
    assert read_fields("") is None and read_fields('{"only": 1}') is None
    assert dict(read_fields(json.dumps({"a": 1, "b": None}))) == {"a": "1", "b": "null"}


def test_groups_and_copies(spark):
    rows = [("b", "Hello, World"), ("a", "hello world!"), ("c", "world hello"), ("d", "k=1; l=2"), ("e", "l: 2 | k: 1"), ("f", "k=1; l=3"), ("g", None), (None, "hello world"), ("a", "hello world!"), ("h", "..."), ("i", ""), ("j", "k=1; l=2; m=")]
    got = groups(spark, rows, ("clash", "clash"))
    assert got == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("d", 2), "e": ("d", 2), "f": ("f", 1), "h": ("h", 2), "i": ("h", 2), "j": ("j", 1)}
    df = spark.createDataFrame(rows, "doc_id string, capsule_text string")
    assert sorted(tuple(r) for r in copies(collapse_layouts(df, "doc_id", "capsule_text")).collect()) == [("a", "b"), ("d", "e"), ("h", "i")]


def test_empty_and_very_long(spark):
    assert collapse_layouts(spark.createDataFrame([], "doc_id string, capsule_text string"), "doc_id", "capsule_text").count() == 0
    long = "word " * 200_000
    assert groups(spark, [("a", long), ("b", long.upper())]) == {"a": ("a", 2), "b": ("a", 2)}


def test_a_hot_group(spark):
    rows = [(f"{i:05d}", ("Same Text", "same text.", "SAME TEXT")[i % 3] if i % 3 else f"text number {i}") for i in range(900)]
    got = groups(spark, rows)
    assert got["00002"] == ("00001", 600) and len(got) == 900


@pytest.mark.parametrize("a,b", [("x² + 1", "x2 + 1"), ("½ cup", "12 cup"), ("item ①", "item 1"), ("Spark™", "sparktm"), ("ﬁle", "file")])
def test_other_compatibility_forms_are_not_folded(a, b):
    assert (canonical(a) == canonical(b)) == (a == "ﬁle")  # a ligature is its letters, in lower case


@pytest.mark.parametrize("a,b", [("ｶﾞｽ 12", "ガス１２"), ("ＡＢＣ－１", "abc1"), ("Ö", "O\u0308")])
def test_width_and_composition_are_folded(a, b):
    assert canonical(a) == canonical(b)


def test_lists_by_spaces_tabs_and_nesting():
    assert read_fields("b=2 a=x y c=3") == [("b", "2"), ("a", "x y"), ("c", "3")]
    assert read_fields("b: 2\ta: x y") == [("b", "2"), ("a", "x y")]
    assert read_fields('{"a": {"b": 1, "c": [true, "x"]}, "d": null}') == [("a/b", "1"), ("a/c/0", "true"), ("a/c/1", "x"), ("d", "null")]
    assert read_fields("see a=1 and b=2") is None


def test_long_names_are_names_if_other_texts_have_them(spark):
    name = " ".join(["word"] * 30)
    rows = [("a", f"{name}: 1; other name of five words: 2"), ("b", f"other name of five words: 2 | {name}: 1"), ("c", f"another such name of words: 1; {name}: 2")]
    assert groups(spark, rows) == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}


def test_comma_lists_with_names_of_several_words(spark):
    rows = [("a", "INDEX_STATE= 3481; QUEUE= 2765; SEEN_BY= run sajizopasa"), ("b", "Queue = 2765, Seen By = run sajizopasa, Index State = 3481"), ("c", "Queue = 2765, Seen By = run sajizopasa, Index State = 3482")]
    assert groups(spark, rows) == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1)}
    # With colons only if the names are names in other texts, in whatever order the rows come.
    colons = [("d", "Seen By: run sajizopasa, queue: 2765, Index State: 3481."), ("e", "Seen by: nobody, they said: 2765"), ("f", "they said: 2765, Seen by: nobody"), ("g", "seen by nobody they said 2765")]
    want = {"a": ("a", 3), "b": ("a", 3), "c": ("c", 1), "d": ("a", 3), "e": ("e", 2), "f": ("e", 2), "g": ("g", 1)}
    assert groups(spark, rows + colons) == want and groups(spark, (rows + colons)[::-1]) == want
    assert groups(spark, colons) == {"d": ("d", 1), "e": ("e", 2), "f": ("e", 2), "g": ("g", 1)}
    assert groups(spark, colons[1:2] + colons[3:]) == {"e": ("e", 2), "g": ("e", 2)}


def own_reading(t):
    """The fields of a text, read without the operator's parser."""
    bare = lambda x: "".join(c for c in unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", x).casefold()) if unicodedata.category(c)[0] in "LNM")
    inner = t.strip().strip("\"'“”„«»‘’`").strip()
    if inner.startswith("{") and "}" in inner:
        try:
            flat = json.loads(inner[: inner.rindex("}") + 1], parse_int=str, parse_float=str)
            return frozenset((bare(k), bare(v if isinstance(v, str) else json.dumps(v))) for k, v in flat.items())
        except ValueError:
            pass
    for sep in "\n|;,":
        parts = [p for p in inner.split(sep) if bare(p)]
        cut = [(p[: min(at)], p[min(at) + 1 :]) for p in parts if (at := [p.index(c) for c in ":=" if c in p])]
        short = [n for n, _ in cut if bare(n) and len(n.replace("_", " ").replace("-", " ").split()) <= 4]
        if len(parts) > 1 and len(short) == len(parts) and (sep != "," or all("=" in p or len(n.split()) == 1 for p, n in zip(parts, short))):
            return frozenset((bare(n), bare(v)) for n, v in cut)
    return bare(t)


def test_against_a_reading_of_its_own(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/capsules.parquet")
    keys = {}
    for r in df.select("doc_id", "capsule_text").distinct().collect():
        if r["doc_id"] is not None and r["capsule_text"] is not None:
            keys.setdefault(own_reading(r["capsule_text"]), set()).add(r["doc_id"])
    want = {(min(v), i) for v in keys.values() for i in v if i != min(v)}
    assert {tuple(r) for r in copies(collapse_layouts(df, "doc_id", "capsule_text")).collect()} == want and want
