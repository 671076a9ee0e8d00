"""Adapters: strict rows with citations from splits of any size, what they reject, and tasks without the library."""

import hashlib
import json
import os
import subprocess
import sys

import pytest

from factweave.sources import adapters as A

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def read(spark, path, name="factweave_registry", **options):
    A.register(spark)
    return spark.read.format(name).options(path=str(path), **options).load()


def test_exact_line_rules(spark, tmp_path):
    (tmp_path / "ledger.jsonl").write_bytes(b'{"id":1}\r\n\n{"id":2}\n{"id":3}')
    want = [(1, sha(b'{"id":1}')), (3, sha(b'{"id":2}')), (4, sha(b'{"id":3}'))]
    for size in (1000, 9, 5, 1):  # splits that cut lines anywhere
        got = A.numbered(read(spark, tmp_path, split=size)).orderBy("line").collect()
        assert [(r.line, r.sha256) for r in got] == want and [r.key for r in got] == ["1", "2", "3"]


BAD = {
    b'{"id":1,"a":1,"a":2}': "repeated key", b'{"id":1,"a":{"b":1,"b":1}}': "repeated key", b'{"id":NaN}': "constant NaN", b'{"id":-Infinity}': "constant -Infinity", b"[]": "not an object", b"7": "not an object", b'{"id":1': "not JSON",
    b'{"id":1e999}': "number beyond a double", b'{"id":"\xff"}': "not UTF-8", b'{"id":"\\ud800"}': "not UTF-8", b'{"id":' + b"[" * 100_000 + b"]" * 100_000 + b"}": "nested too deep", b'{"id":"' + b"x" * 300_000 + b'"}': "longer than 250000 bytes",
    b'{"x":1}': "no id", b'{"id":1,"payload":"p","sha256":"0"}': "payload digest differs",
}


def test_what_is_rejected(spark, tmp_path):
    (tmp_path / "ledger.jsonl").write_bytes(b"\n".join([*BAD, b'{"id":9,"payload":"p","sha256":"' + sha(b"p").encode() + b'"}', b'{"id":9}']) + b"\n")
    rows = read(spark, tmp_path, limit=250_000, split=1000)
    got = {r.sha256: r.problem for r in rows.where("problem is not null").collect()}
    assert got == {sha(k): v for k, v in BAD.items()}
    assert [r.attrs for r in A.accepted(rows).collect() if "payload" in r.attrs] == ['{"id":9,"payload":"p","sha256":"' + sha(b"p") + '"}']
    assert sorted(r.problem for r in A.rejected(rows).collect()) == sorted([*BAD.values(), "repeated key of the table"])


def test_documents(spark, tmp_path):
    (tmp_path / "population.json").write_text(json.dumps([{"namespace": "a", "count": 2, "event_ids": [1, 2]}, {"namespace": "b", "count": 2, "event_ids": [1, 1]}, 5]))
    (tmp_path / "registry-reads.json").write_text(json.dumps({"payload": "p", "ts": "t"}))
    (tmp_path / "registry-refresh.json").write_text("{")
    got = {(r.file.rsplit("/")[-1], r.locator): r for r in read(spark, tmp_path).collect()}
    assert {k: v.problem for k, v in got.items()} == {
        ("population.json", "$[0]"): None, ("population.json", "$[1]"): "count differs from the ids", ("population.json", "$[2]"): "not an object", ("registry-reads.json", "$"): None, ("registry-refresh.json", "$"): "not JSON",
    }
    assert json.loads(got["registry-reads.json", "$"].attrs) == {"ts": "t", "payload_sha256": sha(b"p")} and got["population.json", "$[0]"].key == "a"


def test_wiki_bodies(spark, tmp_path):
    body = "né\n  x".encode()
    row = {"rev_id": 1, "body": body.decode("latin-1"), "body_encoding": "utf8", "body_sha256": sha(body)}
    lines = [row, row | {"rev_id": 2, "body_encoding": "latin1"}, row | {"rev_id": 3, "body": "日本"}, row | {"rev_id": 4, "body_sha256": "0"}, row | {"rev_id": 5, "body": "\xff", "body_sha256": sha(b"\xff")}, {"rev_id": 6}]
    (tmp_path / "revisions.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {r.key or r.n: (r.problem, r.attrs and json.loads(r.attrs)) for r in read(spark, tmp_path, "factweave_wiki").where("locator <> '#'").collect()}
    assert got["1"][1]["normalized_sha256"] == sha("né x".encode()) and "body" not in got["1"][1]
    assert got["2"][1]["normalized_sha256"] == sha(" ".join(body.decode("latin-1").split()).encode())
    assert [got[n][0] for n in (3, 4, 5, 6)] == ["body is no bytes in its encoding", "body digest differs", "body is no bytes in its encoding", "body is no bytes in its encoding"]


def test_unknown_files_are_an_error(spark, tmp_path):
    (tmp_path / "other.txt").write_text("x")
    with pytest.raises(Exception, match="has no table for"):
        read(spark, tmp_path).collect()
    with pytest.raises(Exception, match="none"):
        read(spark, tmp_path / "none").collect()


def test_workers_without_the_library(tmp_path):
    """Sources and bootstrap run where neither the working folder nor PYTHONPATH has the library."""
    script = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
import __spark_entry__
for name in ("export_rejected", "bootstrap_share", "capture_intervals", "coverage_intervals"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
print("done")
"""
    (tmp_path / "go.py").write_text(script)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK_", "PYSPARK_"))}
    out = subprocess.run([sys.executable, "go.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.stdout.strip().endswith("done"), out.stderr[-3000:]
