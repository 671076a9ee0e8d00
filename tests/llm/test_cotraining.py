import os
import subprocess
import sys

import numpy as np

from factweave.llm import cotraining as C

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    n = y.sum()
    return (rank[y == 1].sum() - n * (n - 1) / 2) / (n * (len(y) - n))


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.where("doc_id % 4 = 1")
    out = C.quality(docs, labels.where("doc_id % 4 <> 1"))
    assert out.count() == docs.count()
    t = out.join(held, "doc_id").toPandas()
    y = t.quality.to_numpy()
    print("auc", auc(t.score, y), auc(t.p_text, y), auc(t.p_meta, y), "kept", t.keep.mean(), "accuracy", (t.keep == (y == 1)).mean(), y.mean())
    assert auc(t.score, y) > 0.75 and abs(t.score.mean() - y.mean()) < 0.1


def test_edges(spark):
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b", None, "s", -1)] + [(i, ("good words here " if i % 2 else "bad $$$ ### ") * (i % 9 + 1), "en", "s", 9) for i in range(2, 120)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(2, 80)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in C.quality(docs, labels).collect()}
    assert all(got[i] > 0.5 if i % 2 else got[i] < 0.5 for i in range(80, 120)) and len(got) == 120
    assert {r.score for r in C.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert C.quality(docs.limit(0), labels).collect() == []


def test_rounds_teach_the_weaker_view(spark):
    """With few labels each view learns from what the other names: two views that are told apart by many rare words."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 3000)
    words = [" ".join(f"w{rng.integers(0, 400) * 2 + (c if rng.random() < 0.72 else 1 - c)}" for _ in range(30)) for c in y]
    source = [f"s{rng.integers(0, 60) * 2 + (c if rng.random() < 0.9 else 1 - c)}" for c in y]
    docs = spark.createDataFrame([(i, w, "en", s, 100) for i, (w, s) in enumerate(zip(words, source, strict=True))], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(60)], "doc_id long, quality int")

    def areas(rounds):
        t = C.quality(docs, labels, rounds=rounds).toPandas().set_index("doc_id").loc[range(60, 3000)]
        return [auc(t[c].to_numpy(), y[60:]) for c in ("p_text", "p_meta", "score")]

    before, after = areas(0), areas(4)
    print(before, after)
    assert all(b > a + 0.01 for a, b in zip(before, after, strict=True)), (before, after)


def test_sums_against_brute_force(spark):
    """One round's sums: every labelled row for both views, and what each view names for the other."""
    rng = np.random.default_rng(3)
    text = [" ".join(f"w{rng.integers(0, 9)}" for _ in range(rng.integers(0, 60))) for _ in range(50)]
    batch = next(C._features([C.pa.RecordBatch.from_pydict({"i": list(range(50)), "t": text, "s": ["a", "b"] * 25, "l": ["en"] * 50, "n": [len(t) for t in text]})]))
    label, held = rng.integers(-1, 2, 50).astype(np.int32), rng.random(50) < 0.3
    rows = batch.append_column("quality", C.pa.array(label)).append_column("held", C.pa.array(held))
    opened = C._opened(batch)
    model = {"weights": [(rng.normal(size=C.TABLE), rng.normal(size=C.STATS + 1)), (rng.normal(size=C.META), np.zeros(1))], "mean": np.zeros(C.STATS), "spread": np.ones(C.STATS)}
    score = C.view_scores(model, opened)
    cuts = [tuple(np.quantile(score[:, k], [0.3, 0.6])) for k in (0, 1)]

    class Shared:
        value = (model, cuts)

    flat = np.zeros(-(-C.CELLS // C.CHUNK) * C.CHUNK)
    for out in C._summed(Shared)([rows]):
        for k, part in zip(out.column("chunk").to_pylist(), out.column("part").to_pylist(), strict=True):
            x = np.frombuffer(part)
            flat[k : k + len(x)] = x
    got, want = flat[: C.CELLS].reshape(2, -1), np.zeros((2, C.CELLS // 2))
    _, word, times, stats, meta = opened
    first = np.cumsum(np.bincount(opened[0], minlength=50)) - np.bincount(opened[0], minlength=50)
    for i in range(50):
        for c in (0, 1):
            own = label[i] == c and not held[i]
            said = [label[i] < 0 and (score[i, k] >= cuts[k][1] if c else score[i, k] <= cuts[k][0]) for k in (0, 1)]
            for_text, for_meta = own + C.PSEUDO * said[1], own + C.PSEUDO * said[0]
            mine = range(first[i], first[i + 1] if i < 49 else len(word))
            for j in mine:
                want[c, word[j]] += for_text * times[j] / max(sum(times[list(mine)]), 40)
            for m in meta[i]:
                want[c, C.TABLE + m] += for_meta
            want[c, C.TABLE + C.META :] += for_text * np.concatenate([stats[i], stats[i] ** 2, [1]])
    assert np.allclose(got, want)


def test_better_than_chance():
    y = np.array([0, 1] * 50)
    assert C.better_than_chance(y + 0.0, y) and not C.better_than_chance(-y + 0.0, y) and not C.better_than_chance(np.zeros(100), y) and not C.better_than_chance(np.ones(3), np.ones(3))


def test_workers_without_the_repository(tmp_path):
    """Tasks run where neither the working folder nor PYTHONPATH has the repository."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from factweave.llm import bpe_coding, cotraining, periodic_runs, vector_codes
d = "/root/testdata/sf0.001"
for q in (cotraining.op6_cotraining_quality, bpe_coding.op12_bpe_coding, periodic_runs.op11_periodic_runs, vector_codes.op13_vector_codes):
    assert q(spark, d).count() > 0
print("done")
"""
    (tmp_path / "go.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_"))}
    out = subprocess.run([sys.executable, "go.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]
