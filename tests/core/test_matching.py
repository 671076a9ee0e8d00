"""Live counts where records and claims arrive in any order."""

import hashlib

from factweave.streaming import matching as M

R, C = "event_id long, token_sha string", "event_id long, token string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_any_order(spark, tmp_path):
    """Claims before and after their record, null tokens and commitments, a claim without a record, and a second start."""
    add = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    stream = lambda name, schema: spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")

    def counts():
        rows = M.run(M.live_counts(stream("r", R), stream("c", C)), f"{tmp_path}/out", f"{tmp_path}/state").collect()
        return {r.event_id: (r.recorded, r.n_claims, r.bound, r.mismatch, r.unbound, r.unavailable) for r in rows}

    add("r", [(1, sha("a"))], R)
    add("c", [(2, "b"), (2, "b"), (2, None), (1, "a"), (1, "x")], C)
    assert counts() == {1: (True, 2, 1, 1, 0, 0), 2: (False, 3, 0, 0, 0, 0)}
    add("r", [(2, sha("b")), (3, None)], R)
    assert counts() == {1: (True, 2, 1, 1, 0, 0), 2: (True, 3, 2, 0, 1, 0), 3: (True, 0, 0, 0, 0, 0)}
    add("c", [(3, "q"), (1, "a"), (9, "z")], C)
    assert counts() == {1: (True, 3, 2, 1, 0, 0), 2: (True, 3, 2, 0, 1, 0), 3: (True, 1, 0, 0, 0, 1), 9: (False, 1, 0, 0, 0, 0)}
