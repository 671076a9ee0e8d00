"""Every query with SQL gives the rows of that SQL; the ladder's rules one by one."""

import datetime as dt
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factweave.operators import reconcile as R
from factweave.plans import assumptions, contracts, evidence, exports, facts, ladder, substrates, transcripts  # noqa: F401  (add their queries)
from factweave.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({ORACLE_SQL[name]})").fetchall()
    assert norm(tuple(r) for r in df.select(*columns).collect()) == norm(want)


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


RECORD = "event_id long, ns string, token_sha string, ts timestamp_ntz, idem boolean"
CLAIM = "cid string, event_id long, t0 timestamp_ntz, t1 timestamp_ntz, token string, authentic boolean, exclusive boolean, indep boolean"
SHA = hashlib.sha256(b"t").hexdigest()
CASES = {
    "key_and_version": ((SHA, "n"), []),
    "receipt_binding_mismatch": ((SHA, "n"), [(0, 0, "x", True, True, True)]),
    "clock_bound_missing": ((SHA, "n"), [(0, None, "t", True, True, True)]),
    "contradiction_R3": ((SHA, "n"), [(5, 6, "t", True, True, True)]),
    "execution_window_disjoint": ((SHA, "n"), [(-9, -8, "t", True, True, True), (5, 6, "t", True, True, True)]),
    "namespace_unknown": ((SHA, None), [(0, 0, "t", True, True, True)]),
    "unseparated_candidates": ((SHA, "n"), [(0, 0, "t", True, True, True), (0, 1, "t", True, True, True)]),
    "trust_not_independent": ((SHA, "n"), [(0, 0, "t", True, True, True), (5, 6, "t", True, True, False)]),
    "independent_receipt_binding": ((SHA, "n"), [(0, 0, "t", False, True, True)]),
    "receipt_binding_missing": ((SHA, "n"), [(0, 0, None, True, True, True)]),
    "independent_receipt": ((SHA, "n"), [(0, 0, "t", True, False, True)]),
    "receipt_possession_only": ((SHA, "n"), [(0, 0, "t", False, False, True)]),
    "attribution_unbound": ((None, "n"), [(0, 0, "t", False, True, True)]),
}


def test_ladder(spark):
    records = [(i, ns, sha, day(0), False) for i, ((sha, ns), _) in enumerate(CASES.values())]
    claims = [(f"{i}-{k}", i, day(a), None if b is None else day(b), *rest) for i, (_, cs) in enumerate(CASES.values()) for k, (a, b, *rest) in enumerate(cs)]
    r, c = spark.createDataFrame(records, RECORD), spark.createDataFrame(claims, CLAIM)
    got = {x.event_id: x.method for x in R.reconcile(r, c.orderBy("cid", ascending=False), "1 day").collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES)


def test_bound_and_payload(spark):
    r = spark.createDataFrame([(1, "n", SHA, day(0), False, "p"), (2, "n", SHA, day(0), False, None)], RECORD + ", payload string")
    rows = [(f"{i}-{p}", i, day(0), day(0), "t", True, True, True, p) for i in (1, 2) for p in ("p", "q", None)]
    c = spark.createDataFrame(rows, CLAIM + ", payload string")
    ask = lambda bound, claims: {x.event_id: (x.method, x.n_candidates) for x in R.reconcile(r, claims, bound, payloads=True).collect()}
    assert ask(60, c) == {1: ("unseparated_candidates", 2), 2: ("unseparated_candidates", 3)}
    assert ask(60, c.where("payload is not null"))[1] == ("independent_receipt_binding", 1)
    assert ask(None, c)[1] == ("clock_bound_missing", 3)
    for bad in (-1, float("inf"), float("nan"), "-1 day"):
        with pytest.raises(ValueError):
            R.reconcile(r, c, bad)


def test_keyed_ladder_reaches_its_rules(spark):
    from factweave.plans import ladder

    got = {x.method for x in ladder.reconcile_keyed(spark, "/root/testdata/sf0.01").select("method").distinct().collect()}
    assert got >= {"field_check", "key_and_version", "clock_bound_missing", "namespace_unknown", "unseparated_candidates", "independent_receipt_binding", "receipt_binding_mismatch"}


def test_idempotent(spark):
    r = spark.createDataFrame([(1, "n", SHA, day(0), True), (2, "n", SHA, day(0), False)], RECORD)
    c = spark.createDataFrame([(f"{i}-{k}", i, day(a), day(a), "t", True, True, True) for i in (1, 2) for k, a in enumerate((-8, 9))], CLAIM)
    got = {x.event_id: (x.method, x.cid) for x in R.reconcile(r, c, "10 days", idempotent=True).collect()}
    assert got == {1: ("unseparated_candidates", None), 2: ("unseparated_candidates", None)}
    got = {x.event_id: (x.method, x.cid) for x in R.reconcile(r, c, "8 days", idempotent=True).collect()}
    assert got == {i: ("independent_receipt_binding", f"{i}-0") for i in (1, 2)}
    # a record known only from a listing: its first creation ended long before the next began
    r = spark.createDataFrame([(1, "n", SHA, day(0), True, day(-20)), (2, "n", SHA, day(0), False, day(-20))], RECORD + ", ts_lower timestamp_ntz")
    got = {x.event_id: (x.method, x.cid) for x in R.reconcile(r, c, "10 days", idempotent=True).collect()}
    assert got == {i: ("unseparated_candidates", None) for i in (1, 2)}
    near = c.where("t0 < '2020-01-01'").unionByName(c.where("t0 > '2020-01-01'").withColumns({"t0": F.lit(day(0)), "t1": F.lit(day(0))}))
    got = {x.event_id: (x.method, x.cid) for x in R.reconcile(r, near, "1 day", idempotent=True).collect()}
    assert got == {1: ("independent_receipt_binding", "1-0"), 2: ("unseparated_candidates", None)}


def test_conditions_give_what_they_must(spark):
    got = {x.condition: x for x in assumptions.scenario_report(spark, SF).collect()}
    ids = [x.o_orderkey for x in spark.read.parquet(f"{SF}/orders.parquet").collect()]
    records, invented = [i for i in ids if i % 7], sum(i % 7 == 0 for i in ids)
    others, relayed = sum(i % 4 > 0 for i in records), sum(i % 8 == 0 for i in records)
    want = {
        "clean": (len(records), 0, 0, 0), "fabricated": (len(records), 0, invented, invented), "missing_transcript": (others, 0, invented, invented),
        "copied_public_receipt": (others, 0, relayed, 0), "full_receipt_relay": (0, 0, relayed, 0), "false_exclusivity": (others + relayed, relayed, relayed, 0),
        "shared_tokens_no_attack": (0, 0, 0, 0), "missing_tokens": (0, 0, 0, 0), "missing_clock_bound": (0, 0, 0, 0), "dependent_witnesses": (0, 0, invented, 0),
        "incomplete_capture": (len(records), 0, invented, 0), "capture_window_edge": (len(records), 0, invented, 0),
    }
    assert {k: (x.supported, x.errors, x.captured, x.contradicted) for k, x in got.items()} == want
    assert all(x.passed for x in got.values())


def test_history_takes_the_transcript_from_the_ladder(spark):
    """No second reading of the claims, no join by their ids, in which all records without a claim would meet in one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["version_history"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("lineitem.parquet") == 1 and "hashpartitioning(cid" not in plan


def test_told_columns_are_those_of_the_claim(spark):
    r = spark.createDataFrame([(i, "n", SHA, day(0), True, day(-20)) for i in (1, 2)], RECORD + ", ts_lower timestamp_ntz")
    c = spark.createDataFrame([("1-b", 1, day(-15), day(-15), "t", True, True, True, 7), ("1-c", 1, day(0), day(0), "t", True, True, True, 8), ("2-a", 2, day(9), day(9), "t", True, True, True, 9)], CLAIM + ", transcript long")
    got = {x.event_id: (x.cid, x.transcript) for x in R.reconcile(r, c, "5 days", idempotent=True, told=("transcript",)).collect()}
    assert got == {1: ("1-b", 7), 2: (None, None)}


def test_conditions_share_one_shuffle(spark, capsys):
    assumptions._decided(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(event_id") + plan.count("BroadcastExchange") <= 2 and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["lq5_absent_claims", "lq5_binding_checks"])
def test_claims_move_before_their_digests_are_made(spark, name):
    """Where no side is broadcast, claims are dealt by their source's key, and the claims without a record aren't sorted for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning(l_orderkey" in plan
    assert name != "lq5_absent_claims" or "ShuffledHashJoin [event_id" in plan
