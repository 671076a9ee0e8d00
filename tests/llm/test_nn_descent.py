import os
from collections import defaultdict

import numpy as np
import pytest

from factweave.llm import nn_descent as N

SF = "/root/testdata/sf0.1"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        i = list(ids).index(q)
        s = (x * x[i]).sum(1)
        order = sorted((-v, j) for v, j in zip(s.tolist(), ids) if j != q)[:k]
        out[q] = [(j, -v) for v, j in order]
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    t = df.toPandas()
    x = np.array(t.embedding.tolist(), float)
    want = brute(t.vec_id.tolist(), x, [i for i in t.vec_id if i % 20 == 0], 20)
    got = defaultdict(list)
    for r in N.op2_nn_descent(spark, SF).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert len(got[r.query_id]) == r.rank
    hit = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hit / (20 * len(want)) > 0.9
    at = {i: x[k] for k, i in enumerate(t.vec_id)}
    assert all(abs(s - at[q] @ at[j]) < 1e-12 for q in got for j, s in got[q])


def test_small_exact_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(30)] + [(40 + i, [3.0, 1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(50)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6), (None, [1.0] * 6), (280, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + bad], "vec_id long, embedding array<double>, score double").repartition(3)
    got = defaultdict(list)
    for r in N.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    ids = [i for i, _ in rows]
    want = brute(ids, np.array([v for _, v in rows]), [i for i in ids if i % 20 == 0], 20)
    assert got == {q: [(j, round(s, 9)) for j, s in v] for q, v in want.items()}
    assert N.search(df.limit(0)).collect() == []
    assert N.search(df.where("vec_id = 0")).collect() == []


@pytest.mark.parametrize(("low", "high", "k"), [(-150, -150, 20), (-39, -39, 150), (0, 140, 20), (-150, 150, 20)])
def test_any_magnitude(spark, low, high, k):
    """Recall whatever finite magnitudes meet, and with k above the usual beam."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 16))
    power = np.where(np.arange(400) % 7 == 0, high, low)
    df = spark.createDataFrame([(i, v) for i, v in enumerate((x * 10.0 ** power[:, None]).tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in N.search(df, "vec_id % 40 = 3", k).collect():
        got[r.query_id].append(r.vec_id)
    hit = 0
    for q, found in got.items():
        dot = x @ x[q]  # the order of the products by sign and logarithm
        s = np.sign(dot) * (np.log10(np.abs(dot)) + power + 400)
        want = sorted((-v, j) for j, v in enumerate(s.tolist()) if j != q)[:k]
        assert len(found) == k
        hit += len({j for _, j in want} & set(found)) / k
    assert len(got) == 10 and hit / 10 >= 0.9


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_recall_among_near_copies(spark, kind):
    """Vectors about a few points, and about one that all share: coarse codes and orders don't tell them apart."""
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=(5, 32))[np.arange(1500) % 5] + 0.001 * rng.normal(size=(1500, 32)), 1 + 0.01 * rng.normal(size=(1500, 32))):
        x = x.astype(np.float32).astype(float)
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"vec_id long, embedding {kind}").repartition(3)
        want = brute(range(1500), x, range(0, 1500, 20), 20)
        hit = sum(r.vec_id in {j for j, _ in want[r.query_id]} for r in N.search(df).collect())
        assert hit / (20 * len(want)) >= 0.9
