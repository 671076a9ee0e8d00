"""Cited sources, inventories and streams on small files of their own."""

import hashlib
import random

from pyspark.sql import functions as F

from factweave.operators import estimate as E
from factweave.operators import triage
from factweave.sources import files
from factweave.streaming import live


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'{"a":1}\r\n\n{"a":2}\n{"a":3}')
    (tmp_path / "b.jsonl").write_bytes(b"")
    got = [(r.line, r.text, r.sha256) for r in files.cited_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(n, t, sha(t)) for n, t in ((1, '{"a":1}'), (3, '{"a":2}'), (4, '{"a":3}'))]


def test_lines_over_splits(spark, tmp_path):
    """Lines keep their numbers where a file is read in several splits."""
    (tmp_path / "a.txt").write_text("".join(f"line {n}\n" for n in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = files.cited_lines(spark, str(tmp_path)).select("line", "text").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line, r.text) for r in got) == [(n, f"line {n}") for n in range(1, 3001)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b,a\n1,"x\ny"\n2,"say ""hi"""\n3,\n')
    got = [(r.record, r.a, r.b, r.sha256) for r in files.cited_csv(spark, str(tmp_path), "b string, a string").orderBy("record").collect()]
    want = [("x\ny", "1", '{"a":"x\\ny","b":"1"}'), ('say "hi"', "2", '{"a":"say \\"hi\\"","b":"2"}'), (None, "3", '{"a":null,"b":"3"}')]
    assert got == [(n, a, b, sha(t)) for n, (a, b, t) in enumerate(want, 1)]


def test_json_rules(spark):
    x = spark.createDataFrame([('{"a":[{"b":4}]}',), ('{"a":1,"a":2}',), ('{"a":NaN}',), ("",), (None,)], "t string")
    assert [r[0] for r in x.select(files.json_fragment(F.col("t"), "$.a[0].b", "long")).collect()] == [4, None, None, None, None]


def test_verify(spark):
    found = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "name string, bytes long, sha256 string")
    listed = spark.createDataFrame([("a", 1, "x"), ("b", 1, "q"), ("d", 1, "z")], "name string, bytes long, sha256 string")
    assert {r.name: r.status for r in files.verify(found, listed).collect()} == {"a": "ok", "b": "changed", "c": "extra", "d": "missing"}


def test_ledger(spark):
    x = spark.createDataFrame([(1, "p", sha("p")), (2, "p", "0"), (3, None, None), (4, "p", sha("p")), (4, "p", sha("p"))], "event_id long, payload string, sha256 string")
    got = sorted((r.event_id, r.status) for r in files.checked_ledger(x).collect())
    assert got == [(1, "ok"), (2, "digest_differs"), (3, "ok"), (4, "duplicate"), (4, "duplicate")]


OPTIONS = ["claims_completed_write", "no_write_claim"]
ANSWERS = [
    (None, "no_write_claim", 0.9, "unavailable", "unscored"),
    ({"no_write_claim": 1.0}, "no_write_claim", 0.9, "options_differ", "unscored"),
    ({"claims_completed_write": -0.1, "no_write_claim": 1.1}, "no_write_claim", 0.9, "not_a_probability", "unscored"),
    ({"claims_completed_write": float("nan"), "no_write_claim": 1.0}, "no_write_claim", 0.9, "not_a_probability", "unscored"),
    ({"claims_completed_write": 0.3, "no_write_claim": 0.6}, "no_write_claim", 0.9, "sum_differs", "unscored"),
    ({"claims_completed_write": 0.3, "no_write_claim": 0.7}, None, 0.9, "choice_not_offered", "unscored"),
    ({"claims_completed_write": 0.3, "no_write_claim": 0.7}, "claims_completed_write", 0.9, "choice_not_highest", "unscored"),
    ({"claims_completed_write": 0.7, "no_write_claim": 0.3}, "claims_completed_write", 0.1, "answered", "review"),
    ({"claims_completed_write": 0.05, "no_write_claim": 0.95}, "no_write_claim", 0.9, "answered", "background"),
    ({"claims_completed_write": 0.05, "no_write_claim": 0.95}, "no_write_claim", None, "answered", "uncertain"),
    ({"claims_completed_write": 0.2, "no_write_claim": 0.8}, "no_write_claim", 0.9, "answered", "uncertain"),
]


def test_answers(spark):
    x = spark.createDataFrame([(i, *a[:3]) for i, a in enumerate(ANSWERS)], "i int, p map<string,double>, label string, confidence double")
    status = triage.answer_status(F.col("p"), OPTIONS, F.col("label"))
    queue, _ = triage.write_disposition(status, F.col("label"), F.col("p"), F.col("confidence"))
    got = x.select("i", status.alias("s"), queue.alias("q")).orderBy("i").collect()
    assert [(r.s, r.q) for r in got] == [a[3:] for a in ANSWERS]
    scored = x.where("i = 8").select(triage.answer_status(F.col("p"), OPTIONS, score=F.lit(0.95)), triage.answer_status(F.col("p"), OPTIONS, score=F.lit(0.8))).first()
    assert tuple(scored) == ("answered", "score_differs")


def test_bootstrap(spark):
    rows = spark.range(4000).select((F.col("id") % 2).cast("string").alias("k"), F.when(F.col("id") % 50 != 0, (F.col("id") % 100).cast("double")).alias("v"))
    for r in E.bootstrap_mean(rows, "v", "k").collect():
        true = rows.where((F.col("k") == r.k) & F.col("v").isNotNull()).agg(F.avg("v"), F.stddev("v"), F.count("v")).first()
        assert r.mean == true[0] and r.lower < r.mean < r.upper
        assert 2.5 < (r.upper - r.lower) / (true[1] / true[2] ** 0.5) < 5.5


def test_stream_goes_on(spark, tmp_path):
    """A second run takes only what came since; a key seen before stays one row."""
    at, rows = str(tmp_path / "in"), "event_id long, ts timestamp"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for ids, want in (([1, 2, 2], [1, 2]), ([2, 3], [1, 2, 3])):
        spark.createDataFrame([(i,) for i in ids], "event_id long").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).write.mode("append").parquet(at)
        stream = live.ingest(spark.readStream.schema(rows).parquet(at), "event_id", "ts")
        assert sorted(r.event_id for r in live.drain(stream, out, state).collect()) == want


def test_inventory_in_pieces(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    files_ = {
        "bytes": rng.randbytes(300_000), "ends": rng.randbytes(50_000) + b"\n", "marked": b"\xef\xbb\xbf" + rng.randbytes(40_000), "marked_ends": b"\xef\xbb\xbf\n" + rng.randbytes(40_000) + b"\r\n",
        "line": b"x" * 60_000, "blank": b"\n" * 30_000, "small": b"abc", "packed.gz": rng.randbytes(30_000), "begins": b"\n\n" + b"y\n" * 20_000 + b"z",
    }
    for name, body in files_.items():
        (tmp_path / name).write_bytes(body)
    monkeypatch.setattr(files, "PIECE", 20_000)
    conf = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "1000", "spark.sql.execution.arrow.maxRecordsPerBatch": "50"}
    before, whole = {key: spark.conf.get(key) for key in conf}, []
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        monkeypatch.setattr(files, "_chained", lambda rows, sizes, f=files._chained: whole.append(set(sizes)) or f(rows, sizes))
        got = {r.name: (r.bytes, r.sha256) for r in files.inventory(spark, f"{tmp_path}/*").collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == {name: (len(body), hashlib.sha256(body).hexdigest()) for name, body in files_.items()}
    assert {x.rsplit("/", 1)[1] for x in whole[0]} == set(files_) - {"small", "packed.gz"}
