import random
import re

import numpy as np

from factweave.llm import periodic_runs as R


def brute(words, least):
    """Every run by its definition: for each period the maximal stretches, of one stretch the smallest period."""
    best = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q and i - s + q >= least:
                best.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, q, e - s) for (s, e), q in best.items())


def test_cover_has_every_difference():
    assert {(a - b) % R.V for a in R.COVER for b in R.COVER} == set(range(R.V))


def test_runs_against_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(6)):
            kind, n = rng.randrange(4), rng.randrange(260)
            block = [rng.randrange(5) for _ in range(rng.randrange(1, 60))]
            text = [rng.randrange(2) for _ in range(n)] if kind == 0 else [0] * n if kind == 1 else (block * (n // len(block) + 1))[:n]
            if kind == 3 and n:
                text[rng.randrange(n)] = 7
            texts.append(text)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        for least in (2, 12):
            got = R.periodic(np.array([x for t in texts for x in t], np.int64), bounds, least)
            want = [(s + b, s + b + size, q) for t, b in zip(texts, bounds.tolist(), strict=False) for s, q, size in brute(t, least)]
            assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_extensions_of_long_copies():
    """Extensions far beyond the cover's modulus, through several doublings."""
    base = np.random.default_rng(0).integers(0, 3, 5000)
    word = np.concatenate([base, [9], base[:4000], [8], base[100:]])
    e = R.Extensions(word, np.full(len(word), len(word)))
    i = np.array([0, 10, 3000, 100, 0, 250])
    j = np.array([5001, 5011, 8001, 9002, 1, 9152])
    want = [next((k for k in range(len(word) - b) if word[a + k] != word[b + k]), len(word) - b) for a, b in zip(i, j, strict=True)]
    assert e.between(i, j).tolist() == want and max(want) > 3900


def test_rows(spark):
    long = " ".join(["x y"] * 40_000)
    texts = ["a b c " * 5, None, "", " \t\n", "one two", "é z " * 12, "a b c " * 5, long, "q " + "r s t u " * 4 + "v"]
    rows = [(i if i != 4 else None, t, "w", 1) for i, t in enumerate(texts)] + [(0, texts[0], "w", 1)]
    out = R.word_runs(spark.createDataFrame(rows, "doc_id long, text string, words string, runs int").repartition(3)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((i is None, i or 0) for i, *_ in rows)
    for r in out:
        text = texts[4 if r.doc_id is None else r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert r.n_words == len(words)
        if text == long:
            assert [tuple(x) for x in r.runs] == [(0, 80_000, 2)] and r.collapsed == "x y"
            continue
        runs = brute(words, 12)
        assert [(x.start, x.period, x.length) for x in r.runs] == runs
        gone = {i for s, q, size in runs for i in range(s + q, s + size)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert R.word_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
