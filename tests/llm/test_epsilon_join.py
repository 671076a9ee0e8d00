import numpy as np
import pytest

from factweave.llm import epsilon_join as E


def brute(rows, cosine):
    root, links = {i: i for i, _ in rows}, {i: 0 for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = [(i, v / np.abs(v).max()) for i, v in good]
    for k, (i, a) in enumerate(good):
        for j, b in good[:k]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i, _ in rows} | {None: (0, None)}


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "SLICE", block // 4)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (rng.uniform(0.1, 9) * (centre[i % 12] + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.3]))).tolist()) for i in range(260)]
    rows += [(300 + k, rows[k % 3][1]) for k in range(40)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0] * 15 + [None]), (404, [float("inf")] * 16), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, [float("nan")] * 16), (408, [1e-200] * 4), (409, [3e200] * 4), (410, [1e-310] * 4), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, key int").repartition(4)
    want = brute(rows, 0.95)
    for r in E.cosine_components(df).collect():
        assert (r.n_links, r.component_id) == want[r.vec_id] and r.kept == (r.vec_id is None or r.vec_id == r.component_id), r.vec_id


def test_empty(spark):
    assert E.cosine_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
