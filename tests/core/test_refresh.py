"""Incremental runs: only what changed is derived again; facts and live counts."""

import os

import pytest
from pyspark.sql import functions as F

from factweave.operators.facts import Fact, audit, histogram, measure
from factweave.streaming.refresh import Incremental

ROWS = "source string, k long, v string"
OUT = "k long, n long, source string"


def counted(rows):
    return rows.groupBy("source", "k").agg(F.count("v").alias("n"))


def files_of(root):
    """By source its result files and when they were written."""
    return {s: sorted((p, os.stat(f"{root}/results/source={s}/{p}").st_mtime_ns) for p in os.listdir(f"{root}/results/source={s}") if p.startswith("part-")) for s in "abc"}


def test_one_changed_source_rewrites_one_partition(spark, tmp_path):
    rows = [(s, k, "x") for s in "abc" for k in range(4)]
    df = lambda r: spark.createDataFrame(r, ROWS).repartition(3)
    job = lambda **c: Incremental(spark, str(tmp_path), counted, {"least": 1, **c}, c.pop("build", "1"))
    reasons = lambda x: {r.source: r.reason for r in x.collect()}
    assert reasons(job().run(df(rows))) == dict.fromkeys("abc", "new")
    first = files_of(tmp_path)
    assert reasons(job().run(df(rows[::-1]))) == {} and files_of(tmp_path) == first
    changed = [*rows, ("b", 9, "y")]
    assert reasons(job().run(df(changed))) == {"b": "content"}
    kept = files_of(tmp_path)
    assert {s for s in "abc" if kept[s] != first[s]} == {"b"}
    assert {(r.source, r.k, r.n) for r in job().results(OUT).collect()} == {(s, k, 1) for s in "abc" for k in range(4)} | {("b", 9, 1)}
    with pytest.raises(ValueError, match="another configuration or build: a, b, c"):
        job(least=2).results(OUT)
    assert reasons(job(least=2).run(df(changed).where("source <> 'c'"))) == {"a": "configuration", "b": "configuration"}
    with pytest.raises(ValueError, match="build: c"):
        job(least=2).results(OUT)
    assert reasons(Incremental(spark, str(tmp_path), counted, {"least": 2}, "2").run(df(changed))) == {"a": "build", "b": "build", "c": "configuration"}


def test_streams(spark, tmp_path):
    at, job = str(tmp_path / "in"), Incremental(spark, str(tmp_path / "out"), counted, {}, "1")
    for batch in ([("a", 1, "x"), ("b", 1, "x")], [("a", 1, "x"), ("a", 2, "x")]):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(at)
        job.follow(spark.readStream.schema(ROWS).parquet(at), str(tmp_path / "state"))
    assert {(r.source, r.k, r.n) for r in job.results(OUT).collect()} == {("a", 1, 1), ("a", 2, 1), ("b", 1, 1)}


def test_facts(spark, capsys):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (3, "z")], "k int, v string")
    facts = [Fact("rows", "t", "count(*)"), Fact("keys", "t", "count(DISTINCT k)"), *histogram("t", "v", ("x", "z")), Fact("none", "t", "max(CAST(NULL AS INT))")]
    m = measure({"t": df}, facts)
    assert {r.name: r.value for r in m.collect()} == {"rows": 4, "keys": 3, "t.v.x": 1, "t.v.z": 1, "t.v.other": 2, "none": None}
    p = spark.createDataFrame([("rows", 4), ("keys", 9), ("none", 1), ("t.v.x", 5)], "name string, value long")
    got = {r.name: (r.status, r.measured, r.reason) for r in audit(p, m, {"t.v.x": "why"}).collect()}
    assert got == {"rows": ("exact", 4, None), "keys": ("differs", 3, None), "none": ("not_computable", None, "no computation declared"), "t.v.x": ("not_computable", None, "why")}
    with pytest.raises(ValueError):
        histogram("t", "v", ["it's"])
    with pytest.raises(ValueError):
        measure({"t": df}, facts[:1] * 2)
    from factweave.plans import facts as plans

    plans.facts_compiled(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan parquet") == len(plans.TABLES) and len(plans.FACTS) >= 60
