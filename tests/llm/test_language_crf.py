import itertools
import os

import numpy as np
import pytest

from factweave.llm import language_crf as L

SF = "/root/testdata/sf0.01"


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    score, transition, row = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 0, 0, 2, 3, 3, 3, 3])
    gamma, pair = L.forward_backward(score, row, 4, transition)
    want, want_pair = np.zeros_like(score), np.zeros((3, 3))
    for r in (0, 2, 3):
        at = np.flatnonzero(row == r)
        paths = list(itertools.product(range(3), repeat=len(at)))
        p = np.array([np.exp(sum(score[i, y] for i, y in zip(at, path)) + sum(transition[a, b] for a, b in zip(path, path[1:]))) for path in paths])
        for path, q in zip(paths, p / p.sum()):
            for i, y in zip(at, path):
                want[i, y] += q
            for a, b in zip(path, path[1:]):
                want_pair[a, b] += q
    assert np.allclose(gamma, want) and np.allclose(pair, want_pair)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_held_out_accuracy_and_switches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = L.op7_language_crf(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(out) == docs.count() and len(held) > 150
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()
    texts, langs = L.sample(docs, 40)
    model = L.train(texts, langs, steps=60)
    en, fr = (next(t for t, l in zip(texts, langs) if l == x and len(t.split()) > 60).split()[:30] for x in ("en", "fr"))
    got = L.label_texts(spark.createDataFrame([(1, " ".join(en + fr), 2)], "doc_id long, text string, score int"), model, detail=True).first()
    assert list(got.words) == en + fr
    assert sum(a == b for a, b in zip(got.word_langs, ["en"] * 30 + ["fr"] * 30)) >= 54


def test_edges(spark):
    model = L.train(["the cat and the dog", "le chat et le chien"] * 5, ["en", "fr"] * 5, steps=30)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 ### 34"), (4, "the dog"), (4, "the dog"), (None, "le chien " * 20000)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.lang_pred, r.score > 0) for r in L.label_texts(df, model).collect()))
    assert got == [(0, "fr", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True)]
    empty = L.train([], [])
    assert {r.lang_pred for r in L.label_texts(df, empty).collect()} == {"und"}
    assert L.label_texts(df.limit(0), model).collect() == []


def test_texts_without_spaces_are_read_to_their_end(spark):
    """A run's start may not decide for all of it, and its words cover every byte."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ja, zh = ("".join(chr(c) for c in range(a, a + 60)) for a in (0x3041, 0x4E00))
    made = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    model = L.train([made(ja, 120) for _ in range(40)] + [made(zh, 120) for _ in range(40)], ["ja"] * 40 + ["zh"] * 40, steps=60)
    mixed = made(ja, 16) + made(zh, 4000)
    joined = "\u3000".join([made(ja, 10)] + [made(zh, 10) for _ in range(40)])
    df = spark.createDataFrame([(1, mixed), (2, joined), (3, made(ja, 4000))], "doc_id long, text string")
    got = {r.doc_id: r for r in L.label_texts(df, model, detail=True).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["zh", "zh", "ja"] and all(r.score > 0.9 for r in got.values())
    assert all("".join(got[r.doc_id].words) == r.text for r in df.collect()) and set(got[1].word_langs) == {"ja", "zh"}
    words, ends = L.tokens(pa.array(["a b", "", " " + "\u00e4" * 1000 + "x c", "y" * 48, "\U0001f600" * 100]).slice(1))
    assert max(len(w.encode()) for w in words.to_pylist()) <= L.RUN + 3 and list(np.diff(ends))[0] == 1
    assert "".join(words.to_pylist()) == "\u00e4" * 1000 + "xc" + "y" * 48 + "\U0001f600" * 100
    word = "ab" * 23 + "Q"  # 47 bytes: whole, and its last letters count
    features = L.Features([])
    assert len(features.of(pa.array([word]))[0]) == 48 + 47 + 46 + 4 + 1


def test_sample_is_bounded_by_rows(spark):
    """One id on many rows, equal ones among them, brings per_lang rows a language at most."""
    rows = [(1, f"wort {i % 50}", "de") for i in range(500)] + [(None, "mot", "fr")] * 90 + [(i, f"w {i}", "en") for i in range(40)] + [(7, None, "en"), (8, "x", None)]
    texts, langs = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), 30)
    assert {k: langs.count(k) for k in set(langs)} == {"de": 30, "fr": 1, "en": 30} and len(set(texts)) == 61
