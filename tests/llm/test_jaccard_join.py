import random
import re

import numpy as np

from factweave.llm import jaccard_join as J


def sets_of(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(texts, words, percent):
    sets, root = [sets_of(t, words) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus():
    rng = random.Random(3)
    word = lambda: rng.choice("alpha beta Gamma delta é zeta eta theta".split()) + str(rng.randint(0, 60))
    texts = [None, "", " \t\n", "one", "One", "one two", "one  two", "one two three", "two one", "a b c", "x " * 500]
    for n in (4, 12, 30, 60, 150, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            for _ in range(9):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, n // 40))):
                    copy[rng.randrange(len(copy))] = word()
                if rng.random() < 0.3:
                    copy = copy[rng.randint(0, n // 20) :]
                texts.append(rng.choice([" ", "\n"]).join(copy))
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(5)
    for words, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, words=words, percent=percent).collect()}
        for i, want in enumerate(brute(texts, words, percent)):
            assert got[i] == want, (words, i)


def test_every_link_meets_in_a_tile():
    rng = np.random.default_rng(1)
    for percent in (40, 50, 66, 80, 90):
        low, differ = J.bands(percent)
        for _ in range(300):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(rng.integers(0, n // (8 if percent > 70 else 2) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert np.intersect1d(J._tiles(a, low, differ, percent), J._tiles(b, low, differ, percent)).size


def test_big_tile_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_BLOCK", 4)
    texts = [t for t in corpus() if t and 100 < len(t.split()) < 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts, 3, 90)]


def test_empty_and_stage(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert J.jaccard_components(none).collect() == []
    docs = spark.createDataFrame([(5, "a b c d e f", "en", "s", 11), (4, "A b c d e f", None, "s", 11), (6, None, "en", None, 0), (7, "", "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in J.one_of_each_stage(spark, docs, "").collect()) == [4, 6, 7]
