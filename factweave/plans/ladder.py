"""The whole ladder over records and claims with names, namespaces, digests and payloads, and scores of it, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import checks
from factweave.operators import reconcile as R
from factweave.plans.bindings import bound, with_sql
from factweave.plans.catalogue import query

# Records without a name (29), a namespace (13), a digest (19) or a time (31); claims of another name (11), namespace (7),
# digest (15) or payload (4), by divisors of the record's id and the claim's transcript.
RECORDS = """SELECT event_id, token_sha, idem, CASE WHEN event_id%31<>0 THEN ts END AS ts, CASE WHEN event_id%13<>0 THEN concat('s', CAST(event_id%3 AS STRING)) END AS ns,
    CASE WHEN event_id%29<>0 THEN concat('n', CAST(event_id%5 AS STRING)) END AS name, CASE WHEN event_id%19<>0 THEN concat('v', CAST(event_id AS STRING)) END AS sha,
    CASE WHEN event_id%3<>0 THEN concat('p', CAST(event_id%3 AS STRING)) END AS payload FROM ledger"""
CLAIMS = """SELECT cid, event_id, t0, t1, token, authentic, exclusive, indep, CASE WHEN transcript%7=0 THEN 'other' ELSE concat('s', CAST(event_id%3 AS STRING)) END AS claim_ns,
    CASE WHEN transcript%11=0 THEN 'other' ELSE concat('n', CAST(event_id%5 AS STRING)) END AS claim_name,
    CASE WHEN transcript%3=0 THEN NULL WHEN transcript%15=5 THEN 'other' ELSE concat('v', CAST(event_id AS STRING)) END AS attested,
    CASE transcript%4 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE concat('p', CAST(event_id%3 AS STRING)) END AS payload FROM claims"""


def _records(spark, d):
    return spark.sql(RECORDS.replace("FROM ledger", "FROM {ledger}"), ledger=bound(spark, d, "ledger"))


def _claims(spark, d):
    return spark.sql(CLAIMS.replace("FROM claims", "FROM {claims}"), claims=bound(spark, d, "claims"))


_KEYED = with_sql("ledger", "claims") + f", records AS ({RECORDS}), said AS ({CLAIMS})".replace("STRING", "VARCHAR") + """, pair AS (
      SELECT r.event_id, r.ns, r.name, r.ts, r.payload AS held, c.* EXCLUDE (event_id),
        CASE WHEN c.cid IS NULL THEN NULL WHEN r.token_sha IS NULL THEN 'unavailable' WHEN c.token IS NULL THEN 'unbound' WHEN sha256(c.token) = r.token_sha THEN 'bound' ELSE 'mismatch' END AS bind
      FROM records r LEFT JOIN said c ON c.event_id = r.event_id AND c.claim_name = r.name AND coalesce(r.ns, c.claim_ns) = c.claim_ns AND coalesce(r.sha, c.attested, '') = coalesce(c.attested, r.sha, '')),
    flags AS (SELECT *, cid IS NOT NULL AND bind <> 'mismatch' AS rem, coalesce(t0 > ts + interval '365 days', false) AS late, coalesce(t1 < ts - interval '365 days', false) AS early FROM pair),
    marked AS (SELECT *, rem AND NOT late AND NOT early AS fit FROM flags),
    held AS (SELECT *, count(*) FILTER (fit) OVER w > 1 AND count(*) FILTER (fit AND payload = held) OVER w > 0 AS told FROM marked WINDOW w AS (PARTITION BY event_id)),
    left_ AS (SELECT *, fit AND NOT (told AND coalesce(payload <> held, false)) AS stays FROM held),
    sums AS (SELECT event_id, any_value(ns) AS ns, any_value(name) AS name, count(cid) AS n_all, count(*) FILTER (rem) AS n_rem, count(*) FILTER (rem AND (t0 IS NULL OR t1 IS NULL OR ts IS NULL)) AS n_untimed,
        count(*) FILTER (rem AND late) AS n_late, count(*) FILTER (rem AND (late OR early)) AS n_off, count(*) FILTER (stays) AS n_fit, coalesce(bool_and(indep), false) AS independent,
        max(cid) FILTER (stays) AS cid, max(bind) FILTER (stays) AS bind, bool_or(authentic) FILTER (stays) AS authentic, bool_or(exclusive) FILTER (stays) AS exclusive FROM left_ GROUP BY event_id),
    ruled AS (SELECT *, CASE WHEN name IS NULL THEN 'field_check' WHEN n_all > 0 AND n_rem = 0 THEN 'receipt_binding_mismatch' WHEN n_rem = 0 THEN 'key_and_version' WHEN n_untimed > 0 THEN 'clock_bound_missing'
        WHEN n_late = n_rem THEN 'contradiction_R3' WHEN n_off = n_rem THEN 'execution_window_disjoint' WHEN ns IS NULL THEN 'namespace_unknown' WHEN n_fit > 1 THEN 'unseparated_candidates'
        WHEN NOT independent THEN 'trust_not_independent' WHEN bind = 'bound' AND exclusive THEN 'independent_receipt_binding' WHEN bind = 'unbound' THEN 'receipt_binding_missing'
        WHEN authentic THEN 'independent_receipt' WHEN bind = 'bound' THEN 'receipt_possession_only' ELSE 'attribution_unbound' END AS method FROM sums),
    answers AS (SELECT event_id, method, CASE WHEN method IN ('receipt_binding_mismatch', 'contradiction_R3', 'execution_window_disjoint') THEN 'contradicted' WHEN method LIKE 'independent%' THEN 'supported'
        WHEN method = 'key_and_version' THEN 'unmatched' WHEN method IN ('field_check', 'clock_bound_missing') THEN 'not_assessable' ELSE 'ambiguous' END AS outcome,
        CASE WHEN method = 'receipt_binding_mismatch' THEN n_all WHEN method IN ('contradiction_R3', 'execution_window_disjoint', 'clock_bound_missing') THEN n_rem ELSE n_fit END AS n_candidates,
        CASE WHEN method LIKE 'independent%' THEN cid END AS cid FROM ruled) """


@query(_KEYED + "SELECT event_id, outcome, method, n_candidates, cid FROM answers")
def reconcile_keyed(spark, d):
    """Every rule of the ladder: key, version, binding, clocks, payload, trust."""
    return R.reconcile(_records(spark, d), _claims(spark, d), keyed=True, versions=True, payloads=True)


@query(with_sql("ledger", "claims") + """, k AS (SELECT event_id, count(*) FILTER (token IS NULL OR sha256(token) = token_sha OR token_sha IS NULL) AS n, count(*) AS m FROM claims JOIN ledger USING (event_id) GROUP BY event_id)
    SELECT CASE WHEN m IS NULL THEN 'key_and_version' WHEN n = 0 THEN 'receipt_binding_mismatch' ELSE 'clock_bound_missing' END AS method, count(*) AS n FROM ledger LEFT JOIN k USING (event_id) GROUP BY 1""")
def reconcile_unclocked(spark, d):
    """The ladder where no relation between the clocks is declared."""
    return R.reconcile(bound(spark, d, "ledger"), bound(spark, d, "claims"), bound=None).groupBy("method").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey % 1000 AS claim, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_claims(spark, d):
    """Ids that several claims carry."""
    return checks.repeated(bound(spark, d, "claims").select((F.col("event_id") % 1000).alias("claim")), "claim")
