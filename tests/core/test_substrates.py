"""Substrates, declared trust and what an edge names besides its claim."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factweave.operators import reconcile as R
from factweave.operators import substrate as S
from factweave.plans import substrates


def test_registry_reaches_every_rule(spark):
    rows = substrates.substrate_registry(spark, "/root/testdata/sf0.01").select("method", "witnesses").distinct().collect()
    assert {r.method for r in rows} == {
        "field_check", "receipt_binding_mismatch", "key_and_version", "clock_bound_missing", "contradiction_R3", "execution_window_disjoint", "namespace_unknown",
        "unseparated_candidates", "trust_not_independent", "independent_receipt_binding", "receipt_binding_missing", "independent_receipt", "attribution_unbound",
    }
    assert {"host", "host w1-0"} <= {r.witnesses for r in rows}


def event(cid, witness, day=0, token="t", name="n", event_id="1", **more):
    receipt = {"accepted": True, "name": name, "namespace": "s", "sha256": hashlib.sha256(b"p").hexdigest(), "event_id": event_id, "receipt_token": token} | more
    at = dt.datetime(2020, 1, 1) + dt.timedelta(days=day)
    return (cid, at, at, witness, name, "s", "p", json.dumps(receipt), "registry_write", None, False, False, f"c{cid}")


EVENT = "cid string, t0 timestamp, t1 timestamp, witness string, name string, namespace string, payload string, receipt string, function string, error string, pending boolean, truncated boolean, citation string"
RECORD = "event_id long, ns string, name string, sha string, token_sha string, ts timestamp, payload string, idem boolean, witness string"


def asked(spark, events, relations, repeated="refuse", **trust):
    record = spark.createDataFrame([(1, "s", "n", hashlib.sha256(b"p").hexdigest(), hashlib.sha256(b"t").hexdigest(), dt.datetime(2020, 1, 1), "p", False, "host")], RECORD)
    declared = S.Trust(spark.createDataFrame([("host", "h"), ("a", "da"), ("b", "db")], "witness string, domain string"), relations=relations, **{k: frozenset(v) for k, v in trust.items()})
    edges, pairs = S.attribute(S.registry(), record, spark.createDataFrame(events, EVENT), declared, "1 day", repeated)
    (e,) = edges.collect()
    return e, sorted((r.cid, r.witness, r.citation) for r in R.kept(pairs, edges).collect())


FREE = {("h", "da"): "independent", ("db", "h"): "independent", ("da", "db"): "independent"}


def test_edges_name_witnesses_and_citations(spark):
    e, behind = asked(spark, [event("x", "a")], FREE, exclusive={"da"})
    assert (e.method, e.cid, e.witnesses) == ("independent_receipt_binding", "x", ["a", "host"]) and behind == [("x", "a", "cx")]
    e, behind = asked(spark, [event("x", "a"), event("y", "b")], FREE, exclusive={"da"})
    assert (e.method, e.cid, e.witnesses) == ("unseparated_candidates", None, ["a", "b", "host"]) and [c for c, *_ in behind] == ["x", "y"]
    e, behind = asked(spark, [event("x", "a", token="no"), event("y", "b", token="no")], FREE)
    assert (e.method, e.n_candidates, len(behind)) == ("receipt_binding_mismatch", 2, 2)
    e, behind = asked(spark, [event("x", "a", accepted=False)], FREE)
    assert (e.method, e.witnesses, behind) == ("key_and_version", ["host"], [])


def test_trust_is_over_all_who_claim_the_key(spark):
    """A claim of another event under the same key counts among the observers, and so does a witness without a domain."""
    other = event("y", "b", event_id="2")
    assert asked(spark, [event("x", "a"), other], FREE, exclusive={"da"})[0].outcome == "supported"
    assert asked(spark, [event("x", "a"), other], {**FREE, ("da", "db"): "same"}, exclusive={"da"})[0].method == "trust_not_independent"
    assert asked(spark, [event("x", "a"), event("y", "who", event_id="2")], FREE, exclusive={"da"})[0].method == "trust_not_independent"
    assert asked(spark, [event("x", "host")], FREE, authentic={"h"})[0].method == "trust_not_independent"
    assert asked(spark, [event("x", "a")], FREE, authentic={"da"})[0].method == "independent_receipt"
    assert asked(spark, [event("x", "a")], FREE)[0].method == "receipt_possession_only"


def test_repeated_ids_are_refused(spark):
    twice = [event("x", "a"), event("x", "b", event_id="9")]
    with pytest.raises(ValueError, match="repeated action ids: x"):
        asked(spark, twice, FREE)
    assert asked(spark, twice, FREE, repeated="skip")[0].event_id == "1"


def test_relation_of_domains(spark):
    t = S.Trust(None, relations={("b", "a"): "independent", ("a", "c"): "independent", ("b", "c"): "same"})
    x = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],), (["b", "c"],), (["a", "d"],), ([],)], "d array<string>")
    assert [r[0] for r in x.select(t.relation(F.col("d"))).collect()] == ["same", "independent", "unknown", "same", "unknown", "unknown"]


@pytest.mark.parametrize("name", ["substrate_registry", "substrate_candidates"])
def test_claims_stay_where_they_are_kept(spark, name):
    """Only records are dealt out, as their source's rows: claims meet them, and edges the claims, in the buckets they were written in."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        plan = getattr(substrates, name)(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange SinglePartition" in line]
    assert dealt and all("hashpartitioning(cast(o_orderkey" in line for line in dealt)
    assert "SortMergeJoin [event_id" in plan and "claim_name#" not in plan.split("SortMergeJoin [event_id")[1].split("]")[0]


def test_first_of_equal_claims_is_followed_by_another(spark):
    """A claim that stands twice is not what follows the first."""
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    r = spark.createDataFrame([(i, "n", None, day(0), True, day(-20)) for i in (1, 2)], "event_id long, ns string, token_sha string, ts timestamp, idem boolean, ts_lower timestamp")
    c = [(f"{i}-{a}", i, day(a), day(a), None, True, True, True) for i, days in ((1, (-15, -15, -1, 0)), (2, (-15, -15, -14))) for a in days]
    c = spark.createDataFrame(c, "cid string, event_id long, t0 timestamp, t1 timestamp, token string, authentic boolean, exclusive boolean, indep boolean")
    got = {x.event_id: (x.method, x.n_candidates) for x in R.reconcile(r, c, "5 days", idempotent=True).collect()}
    assert got == {1: ("independent_receipt", 1), 2: ("unseparated_candidates", 3)}
