"""Receipts, commands, outputs, declarations and populations case by case."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from factweave.operators import checks as C
from factweave.operators import reconcile
from factweave.operators import receipts as R
from factweave.sources import files


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_commands(spark):
    cases = {
        "bash -c 'ls -l'": "ls -l", 'sh -c "a b"  ': "a b", "/bin/zsh -lc 'x'": "x", "python3 -c 'p(1)'": "p(1)", "node -e 'q'": "q",
        "bash run.sh": "bash run.sh", "echo -c 'no'": "echo -c 'no'", "bash -c ls": "ls", "": "",
    }
    assert one(spark, [(c,) for c in cases], "c string", R.unwrapped(F.col("c"))) == [(v,) for v in cases.values()]
    args = ['{"cmd": "a", "code": "b"}', '{"code": "b", "command": "c"}', '{"cmd": 1.5, "code": "b"}', "{}", None, "{"]
    assert one(spark, [(a,) for a in args], "a string", R.command_argument(F.col("a")))[1:2] + one(spark, [(a,) for a in args], "a string", R.command_argument(F.col("a")))[3:] == [("c",), (None,), (None,), (None,)]


def test_outputs(spark):
    rows = [("a\n\nb", "a \nb\r\n", True), ("a\nb\nc\nd", "b\nc", True), ("1\n2\n3\n4", "1\n2\n3\n5", True), ("a", "b", False), (None, "a", None), ("a", " \n", None)]
    assert one(spark, [r[:2] for r in rows], "a string, b string", R.same_output(F.col("a"), F.col("b"))) == [(r[2],) for r in rows]


def test_receipt_rules(spark):
    sha = hashlib.sha256(b"p").hexdigest()
    good = {"accepted": "true", "namespace": '"n"', "name": '"f"', "sha256": f'"{sha}"', "event_id": '"1"'}
    text = lambda **x: "{" + ", ".join(f'"{k}": {v}' for k, v in (good | x).items() if v) + "}"
    cases = [(text(), True), (text(accepted="1"), False), (text(accepted="false"), False), (text(name='"g"'), False), (text(namespace='"m"'), False), (text(namespace="7"), False), (text(sha256='"0"'), False), (text(event_id="1"), False), (text(payload='"p"'), True), (text(payload='"q"'), False), (text(event_id=""), False), ("{", False), (None, False)]
    event = {"function": F.lit("write"), "name": F.lit("f"), "payload": F.lit("p"), "namespace": F.lit("n"), "error": F.lit(None).cast("string"), "pending": F.lit(False), "truncated": F.lit(False)}
    ok = R.well_formed(event, F.col("r"), "write")
    assert one(spark, [c[:1] for c in cases], "r string", ok) == [c[1:] for c in cases]
    assert one(spark, [(text(),)], "r string", R.well_formed(event | {"error": F.lit("e")}, F.col("r"), "write"), R.well_formed(event, F.col("r"), "read"), R.claim_key(F.col("r"), ok)) == [(False, False, ("n", "f"))]


def test_times_families_handles(spark):
    rows = [("2020-01-01T00:00:00Z", 1.0), ("2020-01-01T02:00:00+02:00", None), ("2020-01-01T00:00:00", 1.0), ("x+00:00", 1.0), (None, 1.0)]
    t = dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp()
    assert one(spark, rows, "t string, u double", R.interval(F.col("t"), F.col("u"))) == [((t - 1, t + 1),), ((None, None),), (None,), (None,), (None,)]
    assert one(spark, [("high",), ("0.8",), ("0.7",), ("low",), (None,)], "c string", R.family_outcome(F.col("c"))) == [("supported",), ("supported",), ("ambiguous",), ("ambiguous",), ("ambiguous",)]
    said = spark.createDataFrame([("1", "user", "Handle: ann\nHandle: bo"), ("2", "assistant", "Handle: no"), ("3", "system", None)], "id string, role string, text string")
    assert sorted(map(tuple, R.handles(said, r"(?m)^Handle:\s*(\S+)").collect())) == [("1", "ann"), ("1", "bo")]
    with pytest.raises(ValueError):
        R.handles(said, "no group")


def test_population_and_absence(spark):
    records = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 4)], "ns string, event_id long")
    declared = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 5), ("c", 9), ("c", 9)], "ns string, event_id long")
    counts = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "ns string, n long")
    got = {r.ns: tuple(r)[1:] for r in C.population_status(declared, counts, records).collect()}
    assert got == {"a": (2, 0, 0, 0, True), "b": (2, 0, 1, 1, False), "c": (2, 1, 1, 0, False)}
    assert not C.population_status(declared, counts.where("ns <> 'a'"), records).where("complete").count()
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    population = spark.createDataFrame([(n, 2, True, day(0), day(100)) for n in "ab"], "ns string, n long, complete boolean, started_at timestamp, stopped_at timestamp")
    claims = spark.createDataFrame([(f"{n}{k}", 50 + k, n, day(a), day(b), True) for n in "ab" for k, (a, b) in enumerate([(9, 20), (0, 4)])], "cid string, event_id long, ns string, t0 timestamp, t1 timestamp, indep boolean")
    got = {r.cid: r.outcome for r in reconcile.absent_claims(claims, records, population, "1 day", declared).collect()}
    assert got == {"a0": "contradicted", "a1": "not_assessable", "b0": "not_assessable", "b1": "not_assessable"}


def test_open_call_meets_its_transcript(spark):
    t = dt.datetime(2020, 1, 1)
    tools = spark.createDataFrame([(1, 7, t, None, "c", 0), (2, 7, t, t, "c", 1), (3, 8, t, t, "c", 1)], "tool long, transcript long, t0 timestamp, t1 timestamp, cmd string, output long")
    execs = spark.createDataFrame([(10, 7, t + dt.timedelta(days=90), "c", 0), (11, 7, t + dt.timedelta(hours=11), "c", 1)], "exec long, transcript long, t timestamp, cmd string, output long")
    assert sorted(map(tuple, reconcile.corroborate(tools, execs).collect())) == [(1, 10, "supported"), (1, 11, "contradicted"), (2, 11, "supported"), (3, None, "no_pair")]


def test_declarations_pages_artifacts(spark, tmp_path):
    domains = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("c", "x"), ("c", "a"), ("d", None)], "id string, related_to string")
    assert {r.rule: r.n for r in C.declaration_violations(domains).collect()} == {"repeated": 1, "unknown": 1, "one_sided": 2}
    rows = spark.range(30)
    got = C.page(rows, [F.desc("id")], 20, 5).collect()
    assert [r.id for r in got] == [9, 8, 7, 6, 5] and {(r.total, r.truncated) for r in got} == {(30, True)}
    with pytest.raises(ValueError):
        C.page(rows, [F.col("id")], 0, 1001)
    (tmp_path / hashlib.sha256(b"x").hexdigest()).write_bytes(b"x")
    (tmp_path / ("0" * 64)).write_bytes(b"y")
    assert sorted(r.status for r in files.artifacts(spark, str(tmp_path)).collect()) == ["digest_differs", "ok"]
