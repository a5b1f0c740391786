import random
import re

import numpy as np
import pytest

from loamstone.llm import splitting as sp
from loamstone.llm.tokens import TOKEN


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def by_doc(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return {k: sorted(v, key=lambda r: (r["token_start"], r["char_start"])) for k, v in out.items()}


def longest_stretch(text):
    return max(len(TOKEN.findall(p)) for p in re.split(f"[{sp.SPACES}{sp.MARKS}]", text))


random.seed(5)
WORDS = ["alpha", "b", "x" * 30, "漢字テスト", "end.", "stop!\n", "para\n\n", "(quote)", "3.14", "ไทย", "„Wort“", "y" * 100, "  ", "，", "said.\"", "😀", "é" * 26]
TEXTS = ["".join(random.choice(WORDS) + random.choice(["", " ", " ", "\n"]) for _ in range(n)) for n in (0, 1, 5, 40, 200, 700)] + ["z" * 900, "。" * 50, "a b" * 100, " " * 300 + "word", "word" + " \n" * 400 + "next", "one two. " * 300 + " " * 900 + "three four " * 400]


def plain_level(gap):
    """How natural a cut in a gap is, said once more by patterns."""
    if "\n" in gap:
        return sp.PARAGRAPH if re.search(f"\n(?:(?!\n)[{sp.SPACES}])*\n", gap) else sp.LINE
    if re.search(f"[{sp.MARKS}][\"'”’»」』）)\\]]*[{sp.SPACES}]|[。！？।؟]", gap):
        return sp.SENTENCE
    if re.search("[,;:，、；：،؛)）]", gap):
        return sp.CLAUSE
    return sp.SPACE if re.search(f"[{sp.SPACES}{sp.MARKS}]", gap) else sp.HARD


@pytest.mark.parametrize("text", TEXTS)
def test_boundaries_by_patterns(text):
    found = sp.boundaries(sp.flags_of(sp.code_points(text)))
    spans = [m.span() for m in TOKEN.finditer(text)]
    assert found.starts.tolist() == [a for a, _ in spans]
    for (_, end), (start, _), level, cut in zip(spans, spans[1:], found.levels[1:], found.cuts[1:]):
        gap = text[end:start]
        assert level == plain_level(gap)
        spaces = [m.end() for m in re.finditer(f"[{sp.SPACES}]", gap)]
        marks = [m.end() for m in re.finditer(f"[{sp.MARKS},;:，、；：،؛)）]", gap)]
        assert cut == end + (spaces[-1] if spaces else marks[-1] if marks else len(gap))


@pytest.mark.parametrize("size,overlap", [(8, 0), (8, 3), (1, 0), (50, 10), (3, 9)])
def test_pieces_of_whole_texts(spark, size, overlap):
    got = by_doc(sp.split_documents(docs(spark, *TEXTS), size, overlap))
    for i, text in enumerate(TEXTS):
        pieces = got.get(i, [])
        assert bool(pieces) == bool(text)
        eff = min(overlap, max(1, size) - 1)
        for p in pieces:
            assert p["piece_text"] == text[p["char_start"] : p["char_end"]] and p["token_count"] <= size
            assert len(TOKEN.findall(p["piece_text"])) == p["token_count"]
            assert p["doc_tokens"] == len(TOKEN.findall(text)) and p["longest_stretch"] == longest_stretch(text)
        for a, b in zip(pieces, pieces[1:]):
            assert b["token_start"] == a["token_start"] + a["token_count"] - eff
        if not eff:
            assert "".join(p["piece_text"] for p in pieces) == text


@pytest.mark.parametrize("size,overlap", [(8, 0), (8, 3), (50, 10), (2, 1)])
@pytest.mark.parametrize("range_chars", [64, 97, 500])
def test_pieces_do_not_depend_on_ranges(spark, range_chars, size, overlap):
    whole = sp.split_documents(docs(spark, *TEXTS), size, overlap)
    cut = sp.split_documents(docs(spark, *TEXTS), size, overlap, range_chars)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, whole.collect()))


def test_only_oversized_texts_and_no_piece_texts(spark):
    for chars in (60, sp.DEFAULT_RANGE):
        some = sp.split_documents(docs(spark, *TEXTS), 50, 5, chars, oversized_only=True, texts=False)
        every = sp.split_documents(docs(spark, *TEXTS), 50, 5).filter("doc_tokens > 50")
        assert sorted(map(tuple, some.drop("piece_text").collect())) == sorted(map(tuple, every.drop("piece_text").collect()))
        assert some.filter("piece_text is not null").count() == 0


def test_fixed_cuts_are_the_best_boundaries_before_their_token():
    levels = np.zeros(3 * sp.fixed_every(8) + 5, np.uint8)
    levels[sp.fixed_every(8) - 2] = sp.SENTENCE
    ends = {b for _, b in sp.piece_tokens(levels, 8, 0)}
    assert {sp.fixed_every(8) - 2, 2 * sp.fixed_every(8), 3 * sp.fixed_every(8)} <= ends


def test_cuts_at_natural_boundaries(spark):
    text = "One two three four. Five six seven eight nine ten, eleven twelve thirteen.\n\nFourteen fifteen."
    ends = [p["piece_text"].rstrip()[-1] for p in by_doc(sp.split_documents(docs(spark, text), 8, 0))[0]]
    assert ends[0] == "." and ends[-1] == "."
    hard = by_doc(sp.split_documents(docs(spark, "語" * 30), 8, 0))[0]
    assert [p["cut_level"] for p in hard[:-1]] == [sp.HARD] * 3


def test_profiles_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e", "p"), (1, "a b c d e", "p"), (2, "a b c d e", None), (3, "a b c d e", "gone"), (4, None, "p"), (None, "a b c d e", "p"), (5, "", "p"), (6, "w" * 200, "p")]
    d = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id bigint, text string, index_profile_hash string, chunk_size int, overlap int")
    profiles = spark.createDataFrame([("p", 4, 1, False), ("p", 4, 1, False), ("d", 10, 0, True)], "index_profile_hash string, chunk_size int, overlap int, is_default boolean")
    found = sp.oversized(sp.split_by_profile(d, profiles))
    assert sorted((r["doc_id"], r["reason"]) for r in found.collect()) == [(1, "split"), (6, "hard"), (6, "split")]
    assert sp.split_by_profile(d.limit(0), profiles).count() == 0


@pytest.mark.parametrize("overlap,range_bytes", [(0, 101), (3, 101), (3, 1), (3, 1 << 20)])
def test_files_are_cut_as_texts_are(spark, tmp_path, overlap, range_bytes):
    texts = {n: t for n, t in zip("abcdefghi", TEXTS[3:] if range_bytes > 1 else [t[:200] for t in TEXTS[3:]]) if t}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    (tmp_path / "empty").write_bytes(b"")
    paths = [str(tmp_path / n) for n in [*texts, "empty"]]
    paths = [paths[0], *(f"file://{p}" for p in paths[1:]), paths[0]]
    got = {}
    for r in sp.split_files(spark, paths, 8, overlap, range_bytes).collect():
        got.setdefault(r["path"][-1], []).append(r)
    whole = by_doc(sp.split_documents(docs(spark, *texts.values()), 8, overlap))
    assert set(got) == set(texts)
    for i, (n, t) in enumerate(texts.items()):
        pieces = sorted(got[n], key=lambda r: (r["token_start"], r["char_start"]))
        same = ["char_start", "char_end", "token_start", "token_count", "cut_level"]
        assert [[p[c] for c in same] for p in pieces] == [[p[c] for c in same] for p in whole[i]]
        for p in pieces:
            assert t[p["char_start"] : p["char_end"]] == t.encode()[p["byte_start"] : p["byte_end"]].decode()
    assert sp.split_files(spark, [], 8, 0).count() == 0


def test_registered_ranges_cut_most_texts_by_the_stitched_table(spark, data):
    from loamstone.llm import queries as q

    texts = spark.read.parquet(f"{data}/documents.parquet").select("text").collect()
    assert sum(len(r["text"] or "") > q.P1_RANGE for r in texts) > len(texts) / 2 and max(len(r["text"] or "") for r in texts) < sp.DEFAULT_RANGE
    rows = [sorted(map(tuple, q.queries()[n](spark, data).collect())) for n in ("p1_found", "p1_ranges")]
    assert rows[0] == rows[1] and rows[0]
