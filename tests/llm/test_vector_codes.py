import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from factweave.llm import vector_codes as C


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{vec_id: (code, error)} and the digest, by Python integers alone."""
    ok = [(i, [math.floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(ok[0][1]) // parts
    cut = {i: [v[p * d : (p + 1) * d] for p in range(parts)] for i, v in ok}
    books = [[cut[i][p] for i in sorted(cut)[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        near = {i: [min((far(part[p], c), k) for k, c in enumerate(books[p])) for p in range(parts)] for i, part in cut.items()}
        if step == rounds:
            break
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in cut if near[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    flat = ",".join(str(x) for book in books for c in book for x in c)
    return {i: ("".join(f"{k:02x}" for _, k in n), sum(e for e, _ in n)) for i, n in near.items()}, hashlib.sha256(flat.encode()).hexdigest()


@pytest.mark.parametrize("power", [0, 3, 9, 30, 300])
def test_against_brute_force(spark, power):
    rng = np.random.default_rng(power)
    rows = [(int(i), (rng.normal(size=16) * 10.0 ** rng.integers(-3, power + 1)).tolist()) for i in rng.permutation(60)]
    rows += [(100, [0.0] * 16), (101, None), (102, [float("nan")] * 16), (103, [float("inf")] + [0.0] * 15), (104, [None] + [1.0] * 15), (105, [1.0] * 8), (106, []), (107, rows[0][1]), (108, rows[0][1])]
    want, digest = brute([r for r in rows if r[0] not in (105, 106)])
    labelled = [(i, v, None if i % 3 == 0 else i % 2, "c", i) for i, v in rows]
    out = C.encode(spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)).collect()
    assert {r.vec_id for r in out} == set(want)
    key = lambda i: None if i % 3 == 0 else i % 2
    for r in out:
        code, error = want[r.vec_id]
        assert (r.code, r.error, r.codebooks_sha256) == (code, error if error < 2**63 else None, digest)
        fit = [e for i, (_, e) in want.items() if key(i) == key(r.vec_id) and e < 2**63]
        assert r.label_error == (sum(fit) if fit and sum(fit) < 2**63 else None)


def test_small_and_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert C.encode(spark.createDataFrame([], kind)).collect() == []
    assert C.encode(spark.createDataFrame([(1, [1.0] * 9, 1)], kind)).collect() == []  # no eight equal parts
    rows = C.encode(spark.createDataFrame([(1, [1.0] * 8, None), (1, [1.0] * 8, None), (None, [-0.0001] * 8, 2)], kind)).collect()
    digest = hashlib.sha256(",".join([*["4096"] * 2, "-1"] * 8).encode()).hexdigest()  # of two equal entries the second stays unused
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in rows) == [(0, "02" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0)]
    assert {r.codebooks_sha256 for r in rows} == {digest}


def test_limbs():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(2**28), 2**28, (50, 8)), rng.integers(-(2**28), 2**28, (7, 8))
    index, error = C.nearest(a, b)
    far = ((a[:, None] - b[None]) ** 2).sum(2)
    assert index.tolist() == far.argmin(1).tolist() and error.tolist() == far.min(1).tolist()
    assert C.integers(np.array([-0.0001, 1e300, -1e-300]), 4096).tolist() == [-1, int(1e300) * 4096, -1]
