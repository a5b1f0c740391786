import numpy as np

from loamstone.llm import leakage as lk
from loamstone.llm.tokens import TOKEN

ITEM = "it was the miller who lent the paper globe to the old carpenter during the long river fair before the spring tide came in and the painted door was shut"
OTHER = "when a lost courier came to the salt market the weaver left a cracked teapot under the garden wall until the first snowfall"
FILL = " ".join(f"filler{i}" for i in range(60))


def leaks(spark, docs, items, **kw):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, answer string")
    i = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    return {(r["item_id"], r["doc_id"]): r for r in lk.find_leaks(d, i, **kw).collect()}


def test_exact_parts_paraphrases_and_near_misses(spark):
    words = ITEM.split()
    docs = [
        (1, f"{FILL} {' '.join(words[5:18])} {FILL}"),
        (2, f"{FILL} {' '.join(words[5:17])} {FILL}"),
        (3, ITEM.upper()),
        (4, FILL),
        (5, f"{FILL} it was the miller who then lent the paper globe to the carpenter during that river fair until the spring tide came in and the painted door was shut"),
        (6, f"{ITEM} {OTHER}"),
        (7, None), (8, ""), (None, ITEM), (3, ITEM.upper()),
    ]
    items = [(10, ITEM, "painted door"), (11, OTHER, None), (11, OTHER, None), (12, None, "x"), (13, "", "x")]
    for kw in ({}, {"rank": 4}, {"cosine": 0.5}):
        got = leaks(spark, docs, items, **kw)
        exact = {k for k, r in got.items() if r["kind"] == "exact"}
        assert exact == {(10, 1), (10, 3), (10, 6), (11, 6)}, kw
    got = leaks(spark, docs, items)
    assert got[10, 5]["kind"] == "paraphrase" and got[10, 5]["has_answer"] and (10, 2) not in got or got[10, 2]["kind"] == "paraphrase"
    assert got[10, 1]["longest_run"] == 13


def test_short_items_empty_tables_and_long_texts(spark):
    assert leaks(spark, [], [(1, ITEM, None)]) == {} and leaks(spark, [(1, ITEM)], []) == {}
    got = leaks(spark, [(1, f"{FILL} five words in a row {FILL}")], [(1, "five words in a row", None)])
    assert got[1, 1]["kind"] == "paraphrase"
    long = " ".join([FILL] * 500 + [ITEM] + [FILL] * 500)
    assert leaks(spark, [(1, long)], [(1, ITEM, None)])[1, 1]["longest_run"] == len(ITEM.split())


def test_sections_of_a_long_item_overlap_by_a_run(spark, monkeypatch):
    monkeypatch.setattr(lk, "SECTION", 20)
    words = (ITEM + " " + OTHER).split()
    docs = [(i, f"{FILL} {' '.join(words[i : i + 13])} {FILL}") for i in range(0, len(words) - 13)]
    assert {k[1] for k, r in leaks(spark, docs, [(1, " ".join(words), None)]).items() if r["kind"] == "exact"} == set(range(len(words) - 13))


def test_run_and_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(-1, 4, rng.integers(1, 20)), rng.integers(0, 4, rng.integers(1, 20))
        run = max((n for n in range(len(b) + 1) for i in range(len(b) - n + 1) for j in range(len(a) - n + 1) if n == 0 or (a[j : j + n] == b[i : i + n]).all()), default=0)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert lk.longest_run(a, b) == run and lk.common_subsequence(a, b) == table[-1, -1]


def test_space_has_the_singular_vectors(spark):
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 30, 40).tolist() for _ in range(12)]
    idf = rng.uniform(1, 3, 30)
    rows = []
    for x in ids:
        for s in range(len(x) - lk.RUN + 1):
            r = np.zeros(30)
            np.add.at(r, x[s : s + lk.RUN], idf[x[s : s + lk.RUN]])
            rows.append(r)
    want = np.linalg.svd(np.array(rows))[2][:5]
    got = lk.randomised_svd(spark.createDataFrame([(x,) for x in ids], "ids array<bigint>").repartition(3), idf, 5, power=4)
    assert np.abs(np.sum(want.T * got, axis=0)).min() > 0.98
    assert len(TOKEN.findall(ITEM)) > lk.RUN


def broken(words, every, word="zzz"):
    return " ".join(w if i % every != 2 else f"{word}{i} {w}" for i, w in enumerate(words))


def test_a_closer_window_elsewhere_hides_no_paraphrase(spark):
    words, gap = ITEM.split(), " ".join([FILL] * 3)
    far = broken(words, 4)
    docs = [
        (1, f"{' '.join(words[:12])} {gap} {far}"), (2, f"{far} {gap} {' '.join(words[:12])}"),
        (3, f"{broken(words[:25], 12)} {gap} {far}"),  # enough of the item in two places, the answer in one
        (4, f"{' '.join(words[:12])} {gap} {' '.join(words[12:24])}"),  # enough only together
        (5, f"{broken(words[:25], 12)} {gap} painted door {gap}"),
        (6, f"{' '.join(words[:13])} {gap} {far}"),
    ]
    got = leaks(spark, docs, [(10, ITEM, "painted door")])
    assert {k[1]: (r["kind"], r["lcs"], r["has_answer"]) for k, r in got.items()} == {1: ("paraphrase", 30, True), 2: ("paraphrase", 30, True), 3: ("paraphrase", 30, True), 6: ("exact", 30, True)}
    assert {k[1] for k in leaks(spark, docs, [(10, ITEM, None)])} == {1, 2, 3, 5, 6}


def test_many_files_and_few_leaders_find_the_same(spark, monkeypatch):
    words, rng = ITEM.split() + OTHER.split(), np.random.default_rng(8)
    items = [(i, " ".join(rng.permutation(words)[: 9 + i % 20]), None) for i in range(40)]
    docs = [(i, f"{FILL} {broken(items[i % 40][1].split(), 6)} {items[(i * 7) % 40][1]}") for i in range(60)]
    want = {k: tuple(r)[2:3] + tuple(r)[4:] for k, r in leaks(spark, docs, items, cosine=0.6).items()}
    for name, value in (("FILE_ROWS", 16), ("FILE_TOKENS", 40), ("HELD_FILES", 2), ("LEADER_SAMPLE", 10), ("WINDOWS", 16)):
        monkeypatch.setattr(lk, name, value)
    assert {k: tuple(r)[2:3] + tuple(r)[4:] for k, r in leaks(spark, docs, items, cosine=0.6).items()} == want and len(want) > 60


def test_recall_of_planted_paraphrases(spark):
    """Items with a word in seven left out or replaced and one in nine inserted, in long texts of their own words."""
    rng = np.random.default_rng(5)
    vocabulary = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("ran", "sol", "vek", "dim") for c in ("a", "in", "or", "es", "um")]
    sentence = lambda n: [vocabulary[i] for i in (rng.zipf(1.3, n) % len(vocabulary))]
    items = [(i, sentence(30 + i % 25)) for i in range(60)]
    docs = []
    for i, ws in items:
        out = []
        for w in ws:
            if rng.random() < 1 / 9:
                out.append(str(rng.choice(vocabulary)))
            out.append(w if rng.random() > 1 / 7 else str(rng.choice(vocabulary)) if rng.random() < 0.5 else "")
        docs.append((i, " ".join([*sentence(150), *filter(None, out), *sentence(150)])))
    got = leaks(spark, docs, [(i, " ".join(ws), None) for i, ws in items])
    recall = sum((i, i) in got for i, _ in items) / len(items)
    print("recall of planted paraphrases", recall)
    assert recall >= 0.9


def test_best_place_against_every_window():
    rng = np.random.default_rng(4)
    for _ in range(100):
        ids, item, answer = rng.integers(-1, 9, rng.integers(20, 200)), rng.integers(0, 9, rng.integers(3, 20)), rng.integers(0, 9, rng.integers(1, 3))
        searcher = lk._Searcher.__new__(lk._Searcher)
        searcher.sections, searcher.masks = {0: {1: (1, item, answer)}}, lambda *_: lk.token_masks(item)
        starts = np.unique(rng.integers(0, len(ids), 12)).tolist()
        near = {s: ids[max(0, s - len(item)) : s + lk.RUN + len(item)] for s in starts}
        assert searcher._best(ids, (0, 1), starts, 0) == max(lk.common_subsequence(n, item) for n in near.values())
        assert searcher._with_answer(ids, (0, 1), starts) == [s for s in starts if lk.longest_run(near[s], answer) == len(answer)]
