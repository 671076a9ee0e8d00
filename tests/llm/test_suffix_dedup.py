import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from factweave.llm.suffix_dedup import op1_suffix_dedup, remove_repeats, strip_stage


def brute(texts, window):
    seen = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        for p in range(len(t) - window + 1):
            seen[t[p : p + window]].append((i, p))
    gone = [bytearray(len(t)) for t in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p : p + window] = b"\1" * window
    out = []
    for t, g in zip(raw, gone, strict=True):
        kept = bytes(c for c, x in zip(t, g, strict=True) if not x)
        spans = sum(1 for k, x in enumerate(g) if x and (k == 0 or not g[k - 1]))
        out.append((len(t), sum(g), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(75, 140)) for _ in range(6)]
    texts = [None, "", "short", "x" * 3000, "ab" * 700, "x" * 399, "x" * 400, text(4000)]
    for k in range(50):
        own = [text(rng.randint(0, 120)) for _ in range(3)]
        cut = rng.choice(shared)
        texts.append(own[0] + cut[rng.randint(0, 60) : len(cut) - rng.randint(0, 60)] + own[1] + rng.choice(shared) + own[2])
    texts += [texts[10], texts[10], texts[11], texts[12][:700], texts[13] + "q"]
    base = texts[20]
    texts += [base[:k] + "#" + base[k + 1 :] for k in range(100, len(base), 90)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in remove_repeats(df, shard_bytes=20_000).withColumn("h", F.sha2("kept", 256)).collect()}
    for i, want in enumerate(brute(texts, 400)):
        assert got[i] == want, i


def test_empty_and_stage(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(df).collect() == []
    docs = spark.createDataFrame([(1, "é" * 600 + "ab", "fr", None, 602), (2, "c" + "é" * 600, None, "s", 601), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in strip_stage(spark, docs, "").collect()}
    assert got[1].text == "ab" and got[1].n_chars == 2 and got[2].text == "c" and got[3].text == "" and got[1].source is None


def test_stage_drops_passages_of_over_50_words(spark):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passages = [text(51) for _ in range(8)]
    assert all(256 < len(p.encode()) < 400 for p in passages)
    texts = [text(rng.randint(0, 300)) + " " + passages[k % 8] + " " + text(rng.randint(0, 300)) for k in range(24)] + [text(400) for _ in range(6)]
    texts += [texts[0][:50] + "#" + texts[0][50:], None, "short"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = {r.doc_id: r.text for r in strip_stage(spark, docs, "").collect()}
    assert not any(p[20:-20] in t for p in passages for t in got.values())
    assert all(got[i] == texts[i] for i in range(24, 30))
    assert [hashlib.sha256(got[i].encode()).hexdigest() for i in range(1, 30) if "\ufffd" not in got[i]] == [brute(texts, 256)[i][3] for i in range(1, 30) if "\ufffd" not in got[i]]


def test_query_counts_passages_of_over_50_words_beside_the_contract(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passages = [text(51) for _ in range(6)] + [text(120)]
    assert all(256 < len(p.encode()) < 400 for p in passages[:6])
    texts = [text(rng.randint(0, 300)) + " " + passages[k % 7] + " " + text(rng.randint(0, 300)) for k in range(21)] + [text(400) for _ in range(6)]
    texts += [None, "", "short", "x" * 255, "y" * 300, "y" * 300, "z" * 399, "z" * 399, "w" * 400, passages[6], passages[0] + passages[0]]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_suffix_dedup(spark, str(tmp_path)).collect()}
    for i, (contract, passage) in enumerate(zip(brute(texts, 400), brute(texts, 256), strict=True)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == contract, i
        assert (got[i].passage_bytes, got[i].passage_spans) == passage[1:3], i
    assert all(got[i].passage_bytes > 255 for i in range(21)) and sum(got[i].n_removed > 0 for i in range(21)) == 3
    assert not any(got[i].passage_bytes for i in range(21, 27))
