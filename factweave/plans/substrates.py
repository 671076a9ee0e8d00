"""Two kinds of evidence through one reconciliation: registry writes with receipts, and wiki saves; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import checks
from factweave.operators import reconcile as R
from factweave.operators import substrate as S
from factweave.plans.bindings import bound, by_event, with_sql
from factweave.plans.catalogue import query
from factweave.sources.files import in_buckets

# Records without a name (29), a namespace (13), a digest (19) or a time (31) by divisors of their ids; claims of another
# namespace (7), name (11) or payload (4), or whose receipts were refused (17), by their transcripts.
RECORDS = """SELECT event_id, token_sha, idem, CASE WHEN event_id%31<>0 THEN ts END AS ts, CASE WHEN event_id%13<>0 THEN concat('s', CAST(event_id%3 AS STRING)) END AS ns,
    CASE WHEN event_id%29<>0 THEN concat('n', CAST(event_id%5 AS STRING)) END AS name, concat('p', CAST(event_id%3 AS STRING)) AS payload,
    CASE WHEN event_id%19<>0 THEN sha2(concat('p', CAST(event_id%3 AS STRING)),256) END AS sha, 'host' AS witness FROM ledger"""
CLAIMS = """SELECT cid, event_id, t0, t1, token, concat('w', CAST(event_id%3 AS STRING), '-', CAST(transcript%2 AS STRING)) AS witness, transcript%17<>0 AS accepted,
    CASE WHEN transcript%7=0 THEN 'other' ELSE concat('s', CAST(event_id%3 AS STRING)) END AS namespace, CASE WHEN transcript%11=0 THEN 'other' ELSE concat('n', CAST(event_id%5 AS STRING)) END AS name,
    CASE WHEN transcript%4=1 THEN 'other' ELSE concat('p', CAST(event_id%3 AS STRING)) END AS payload FROM claims"""
DOMAINS = {"host": "host", "w0-0": "d0", "w0-1": "d0", "w1-0": "d1", "w1-1": "d2", "w2-0": "d3"}  # w2-1 has none
RELATIONS = {("host", "d0"): "same", ("d1", "host"): "independent", ("host", "d2"): "independent", ("d1", "d2"): "independent", ("d2", "d0"): "same"}
BOUND = "365 days"


def _records(spark, d):
    return spark.sql(RECORDS.replace("FROM ledger", "FROM {ledger}"), ledger=by_event(spark, d, "ledger", text=True))


def _events(spark, d):
    """Claims as tool events: arguments and a JSON receipt."""
    c = spark.sql(CLAIMS.replace("FROM claims", "FROM {claims}"), claims=by_event(spark, d, "claims", text=True))
    receipt = F.to_json(F.struct("accepted", "name", "namespace", F.sha2("payload", 256).alias("sha256"), F.col("event_id").cast("string").alias("event_id"), F.col("token").alias("receipt_token")))
    no = F.lit(False)
    return c.select("cid", "t0", "t1", "witness", "name", "namespace", "payload", receipt.alias("receipt"), F.lit("registry_write").alias("function"), F.lit(None).cast("string").alias("error"), no.alias("pending"), no.alias("truncated"), F.concat(F.lit("c-"), "cid").alias("citation"))


def _trust(spark):
    return S.Trust(spark.createDataFrame(list(DOMAINS.items()), "witness string, domain string"), frozenset({"d1"}), frozenset({"d2"}), RELATIONS)


def _attributed(spark, d):
    return S.attribute(S.registry(), _records(spark, d), _events(spark, d), _trust(spark), BOUND, repeated="skip", dealt=True)


_CASE = " ".join(f"WHEN '{w}' THEN '{x}'" for w, x in DOMAINS.items())
_KNOWN = ", ".join(f"('{min(p)}', '{max(p)}', '{r}')" for p, r in RELATIONS.items())
_SQL = with_sql("ledger", "claims") + f", records AS ({RECORDS}), said AS ({CLAIMS})".replace("sha2(", "sha256(").replace(",256)", ")").replace("STRING", "VARCHAR") + f""",
    made AS (SELECT *, sha256(payload) AS attested, CASE witness {_CASE} END AS domain FROM said WHERE accepted),
    known(a, b, relation) AS (VALUES {_KNOWN}),
    seen AS (SELECT DISTINCT r.ns, r.name, domain FROM (SELECT DISTINCT ns, name FROM records) r JOIN (SELECT DISTINCT namespace, name, coalesce(domain, '?') AS domain FROM made) m ON r.ns = m.namespace AND r.name = m.name UNION SELECT ns, name, 'host' FROM records WHERE ns IS NOT NULL AND name IS NOT NULL),
    trusted AS (SELECT x.ns, x.name, bool_and(coalesce(relation, '') = 'independent') AS trusted FROM seen x JOIN seen y ON x.ns = y.ns AND x.name = y.name AND x.domain < y.domain LEFT JOIN known k ON k.a = x.domain AND k.b = y.domain GROUP BY x.ns, x.name),
    pair AS (SELECT r.event_id, r.ns, r.name, r.ts, r.idem, r.payload AS held, coalesce(t.trusted, false) AS trusted, c.cid, c.t0, c.t1, c.token, c.payload, c.witness, coalesce(c.domain = 'd1', false) AS authentic, coalesce(c.domain = 'd2', false) AS exclusive,
        CASE WHEN c.cid IS NULL THEN NULL WHEN r.token_sha IS NULL THEN 'unavailable' WHEN c.token IS NULL THEN 'unbound' WHEN sha256(c.token) = r.token_sha THEN 'bound' ELSE 'mismatch' END AS bind
      FROM records r LEFT JOIN trusted t ON t.ns = r.ns AND t.name = r.name LEFT JOIN made c ON c.event_id = r.event_id AND c.name = r.name AND coalesce(r.ns, c.namespace) = c.namespace AND coalesce(r.sha, c.attested) = c.attested),
    flags AS (SELECT *, cid IS NOT NULL AND bind <> 'mismatch' AS rem, coalesce(t0 > ts + interval '365 days', false) AS late, coalesce(t1 < ts - interval '365 days', false) AS early FROM pair),
    marked AS (SELECT *, rem AND NOT late AND NOT early AS fit FROM flags),
    placed AS (SELECT *, row_number() OVER (PARTITION BY event_id, fit ORDER BY t0, t1, cid) AS place, lead(t0) OVER (PARTITION BY event_id, fit ORDER BY t0, t1, cid) AS next, count(*) FILTER (fit) OVER (PARTITION BY event_id) AS fits FROM marked),
    first AS (SELECT event_id, cid AS alone FROM placed WHERE fit AND place = 1 AND fits > 1 AND idem AND t1 + interval '730 days' < next),
    held AS (SELECT m.*, f.alone, f.alone IS NULL AND count(*) FILTER (fit) OVER w > 1 AND count(*) FILTER (fit AND payload = held) OVER w > 0 AS told FROM marked m LEFT JOIN first f ON f.event_id = m.event_id WINDOW w AS (PARTITION BY m.event_id)),
    rest AS (SELECT *, CASE WHEN alone IS NOT NULL THEN coalesce(cid = alone, false) ELSE fit AND NOT (told AND payload <> held) END AS stays FROM held),
    sums AS (SELECT event_id, any_value(ns) AS ns, any_value(name) AS name, bool_and(trusted) AS independent, count(cid) AS n_all, count(*) FILTER (rem) AS n_rem, count(*) FILTER (rem AND (t0 IS NULL OR t1 IS NULL OR ts IS NULL)) AS n_untimed,
        count(*) FILTER (rem AND late) AS n_late, count(*) FILTER (rem AND (late OR early)) AS n_off, count(*) FILTER (stays) AS n_fit, max(cid) FILTER (stays) AS cid, max(bind) FILTER (stays) AS bind, bool_or(authentic) FILTER (stays) AS authentic, bool_or(exclusive) FILTER (stays) AS exclusive FROM rest GROUP BY event_id),
    ruled AS (SELECT *, CASE WHEN name IS NULL THEN 'field_check' WHEN n_all > 0 AND n_rem = 0 THEN 'receipt_binding_mismatch' WHEN n_rem = 0 THEN 'key_and_version' WHEN n_untimed > 0 THEN 'clock_bound_missing'
        WHEN n_late = n_rem THEN 'contradiction_R3' WHEN n_off = n_rem THEN 'execution_window_disjoint' WHEN ns IS NULL THEN 'namespace_unknown' WHEN n_fit > 1 THEN 'unseparated_candidates'
        WHEN NOT independent THEN 'trust_not_independent' WHEN bind = 'bound' AND exclusive THEN 'independent_receipt_binding' WHEN bind = 'unbound' THEN 'receipt_binding_missing'
        WHEN authentic THEN 'independent_receipt' WHEN bind = 'bound' THEN 'receipt_possession_only' ELSE 'attribution_unbound' END AS method FROM sums),
    answers AS (SELECT event_id, method, CASE WHEN method IN ('receipt_binding_mismatch', 'contradiction_R3', 'execution_window_disjoint') THEN 'contradicted' WHEN method LIKE 'independent%' THEN 'supported'
        WHEN method = 'key_and_version' THEN 'unmatched' WHEN method IN ('field_check', 'clock_bound_missing') THEN 'not_assessable' ELSE 'ambiguous' END AS outcome,
        CASE WHEN method = 'receipt_binding_mismatch' THEN n_all WHEN method IN ('contradiction_R3', 'execution_window_disjoint', 'clock_bound_missing') THEN n_rem ELSE n_fit END AS n_candidates, CASE WHEN method LIKE 'independent%' THEN cid END AS cid FROM ruled),
    behind AS (SELECT r.event_id, r.cid, r.witness, 'c-' || r.cid AS citation FROM rest r JOIN answers a ON a.event_id = r.event_id WHERE r.cid IS NOT NULL AND CASE WHEN method IN ('field_check', 'key_and_version') THEN false WHEN method = 'receipt_binding_mismatch' THEN true
        WHEN method IN ('contradiction_R3', 'execution_window_disjoint', 'clock_bound_missing') THEN rem ELSE stays END) """


@query(_SQL + "SELECT a.event_id, outcome, method, n_candidates, cid, array_to_string(list_sort(list_distinct(list_append(coalesce(w, []), 'host'))), ' ') AS witnesses FROM answers a LEFT JOIN (SELECT event_id, list(witness) AS w FROM behind GROUP BY event_id) b ON b.event_id = a.event_id")
def substrate_registry(spark, d):
    """Registry records against tool events whose receipts are well formed, under declared trust."""
    edges, _ = _attributed(spark, d)
    return edges.select(F.col("event_id").cast("long").alias("event_id"), "outcome", "method", "n_candidates", "cid", F.array_join("witnesses", " ").alias("witnesses"))


@query(_SQL + "SELECT event_id, cid, witness, citation FROM behind")
def substrate_candidates(spark, d):
    """The claims that stand behind each edge, with witness and citation."""
    edges, pairs = _attributed(spark, d)
    return R.kept(pairs, edges).withColumn("event_id", F.col("event_id").cast("long"))


@query(with_sql("revs") + """, s AS (SELECT rev AS save, CASE WHEN rev % 4 = 0 THEN rev + 1 ELSE rev END AS ref, page FROM revs), r AS (SELECT rev, page FROM revs UNION ALL SELECT rev, page FROM revs WHERE rev % 9 = 0)
    SELECT save AS event_id, count(r.rev) AS n_candidates, CASE WHEN count(r.rev) = 1 THEN 'supported' WHEN count(r.rev) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome, CASE WHEN count(r.rev) = 1 THEN min(r.rev) END AS cid,
      CASE WHEN count(r.rev) > 0 THEN 'archive log' ELSE 'log' END AS witnesses FROM s LEFT JOIN r ON r.rev = s.ref AND r.page = s.page GROUP BY save""")
def substrate_wiki(spark, d):
    """Save events against the revisions they name, of which every ninth is stored twice."""
    r = bound(spark, d, "revs").select("rev", "page")
    saves = r.select(F.col("rev").alias("event_id"), F.when(F.col("rev") % 4 == 0, F.col("rev") + 1).otherwise(F.col("rev")).alias("revision_ref"), "page", F.lit("log").alias("witness"))
    stored = r.unionByName(r.where("rev % 9 = 0")).withColumn("witness", F.lit("archive"))
    edges, _ = S.attribute(S.wiki_saves(), saves, stored, repeated="skip")
    return edges.select("event_id", "n_candidates", "outcome", "cid", F.array_join("witnesses", " ").alias("witnesses"))


@query(_SQL + """, edges AS (SELECT event_id, outcome, CASE WHEN event_id % 7 = 3 THEN n_candidates + 1 ELSE n_candidates END AS n_candidates, event_id % 11 = 4 AS bare FROM answers), b AS (SELECT *, event_id % 5 = 1 AS uncited, event_id % 6 = 2 AS lost FROM behind)
    SELECT 'supported_by_other_than_one' AS rule, count(*) AS n FROM edges WHERE outcome = 'supported' AND event_id % 7 = 3 UNION ALL SELECT 'object_not_candidate', 0 UNION ALL SELECT 'no_witness', count(*) FROM edges WHERE bare
    UNION ALL SELECT 'candidates_differ', count(*) FROM edges WHERE event_id % 7 = 3 UNION ALL SELECT 'not_cited', count(*) FROM b WHERE uncited UNION ALL SELECT 'claim_unknown', count(*) FROM b WHERE lost UNION ALL SELECT 'seen_by_another', 0
    UNION ALL SELECT 'witness_not_named', count(*) FROM b WHERE event_id % 11 = 4""")
def attribution_invariants(spark, d):
    """The invariants over what reconciliation gave, after some edges lost their witnesses (11) or count one claim too many
    (7), some claims their citation (5), and some were taken out of the source (6), by their records' ids."""
    edges, pairs = _attributed(spark, d)
    edges = in_buckets(edges, "edges", "event_id", dealt=True)  # both are asked several times
    behind = in_buckets(R.kept(pairs, edges), "behind", "event_id", dealt=True)
    edges, k = edges.withColumn("k", F.col("event_id").cast("long")), F.col("k")
    behind = behind.withColumn("citation", F.when(F.col("event_id").cast("long") % 5 != 1, F.col("citation")))
    bad = edges.withColumn("witnesses", F.when(k % 11 == 4, F.array().cast("array<string>")).otherwise(F.col("witnesses"))).withColumn("n_candidates", F.col("n_candidates") + F.when(k % 7 == 3, 1).otherwise(0))
    source = spark.sql(CLAIMS.replace("FROM claims", "FROM {claims}"), claims=bound(spark, d, "claims")).where("event_id % 6 <> 2").select("cid", "witness")
    return checks.attribution_violations(bad, behind, source)
