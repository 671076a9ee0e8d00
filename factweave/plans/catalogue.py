"""Registered queries by name, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factweave.functions import redaction
from factweave.operators import estimate as E
from factweave.operators import ordered
from factweave.operators import lineage as L
from factweave.operators import reconcile as R
from factweave.operators import triage
from factweave.plans.bindings import based_revisions, bound, by_event, table, with_sql
from factweave.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _ladder_sql(idempotent: bool = False, ns: str = "ns", n: str = "") -> str:
    one = "CASE WHEN fit THEN {} END"
    alone = "(idem AND n_fit > 1 AND fits[1].t1 + interval '730 days' < fits[2].t0)"
    fits = ", list(struct_pack(t0 := t0, t1 := t1, cid := cid, bind := bind, authentic := authentic, exclusive := exclusive) ORDER BY t0, t1, cid) FILTER (fit) AS fits" if idempotent else ""
    pick = lambda c: f"CASE WHEN {alone} THEN fits[1].{c} ELSE one_{c} END" if idempotent else f"one_{c}"
    return with_sql("ledger", "claims") + f""", pair AS (
        SELECT l.event_id, {ns} AS ns, l.idem, c.*, l.ts,
          CASE WHEN c.cid IS NULL THEN NULL WHEN l.token_sha IS NULL THEN 'unavailable' WHEN c.token IS NULL THEN 'unbound' WHEN sha256(c.token) = l.token_sha THEN 'bound' ELSE 'mismatch' END AS bind
        FROM ledger l LEFT JOIN (SELECT cid, event_id AS claim_event, t0, t1, token, authentic, exclusive, indep FROM claims) c ON c.claim_event = l.event_id),
      flags AS (SELECT *, cid IS NOT NULL AND bind <> 'mismatch' AS rem, t0 > ts + interval '365 days' AS late, t1 < ts - interval '365 days' AS early FROM pair),
      marked AS (SELECT *, rem AND NOT (late OR early) AS fit FROM flags),
      sums AS (SELECT event_id, any_value(ns) AS ns, any_value(idem) AS idem, count(cid) AS n_all, count(*) FILTER (rem) AS n_rem, count(*) FILTER (rem AND late) AS n_late,
          count(*) FILTER (rem AND (late OR early)) AS n_off, count(*) FILTER (fit) AS n_fit, coalesce(bool_and(indep), false) AS independent,
          max({one.format('cid')}) AS one_cid, max({one.format('bind')}) AS one_bind, bool_or({one.format('authentic')}) AS one_authentic, bool_or({one.format('exclusive')}) AS one_exclusive{fits} FROM marked GROUP BY event_id),
      kept AS (SELECT event_id, ns, n_all, n_rem, n_late, n_off, independent, {f"CASE WHEN {alone} THEN 1 ELSE n_fit END" if idempotent else "n_fit"} AS n_fit, {pick('cid')} AS cid, {pick('bind')} AS bind, {pick('authentic')} AS authentic, {pick('exclusive')} AS exclusive FROM sums),
      ruled AS (SELECT *, CASE WHEN n_all > 0 AND n_rem = 0 THEN 'receipt_binding_mismatch' WHEN n_rem = 0 THEN 'key_and_version' WHEN n_late = n_rem THEN 'contradiction_R3'
          WHEN n_off = n_rem THEN 'execution_window_disjoint' WHEN ns IS NULL THEN 'namespace_unknown' WHEN n_fit > 1 THEN 'unseparated_candidates' WHEN NOT independent THEN 'trust_not_independent'
          WHEN bind = 'bound' AND exclusive THEN 'independent_receipt_binding' WHEN bind = 'unbound' THEN 'receipt_binding_missing' WHEN authentic THEN 'independent_receipt'
          WHEN bind = 'bound' THEN 'receipt_possession_only' ELSE 'attribution_unbound' END AS method FROM kept),
      answers AS (SELECT event_id, CASE WHEN method IN ('receipt_binding_mismatch','contradiction_R3','execution_window_disjoint') THEN 'contradicted' WHEN method IN ('independent_receipt_binding','independent_receipt') THEN 'supported'
          WHEN method = 'key_and_version' THEN 'unmatched' ELSE 'ambiguous' END AS outcome, method,
          CASE method WHEN 'receipt_binding_mismatch' THEN n_all WHEN 'contradiction_R3' THEN n_rem WHEN 'execution_window_disjoint' THEN n_rem ELSE n_fit END AS n_candidates,
          CASE WHEN method IN ('independent_receipt_binding','independent_receipt') THEN cid END AS cid FROM ruled){n} """


ANSWERS = "SELECT event_id, outcome, method, n_candidates, cid FROM answers"


def _answers(spark, d, idempotent=False, records=None, told=()):
    return R.reconcile(records if records is not None else bound(spark, d, "ledger"), bound(spark, d, "claims"), idempotent=idempotent, told=told)


@query(_ladder_sql() + ANSWERS)
def lq1_attribution(spark, d, answers=None):
    return (answers if answers is not None else _answers(spark, d)).select("event_id", "outcome", "method", "n_candidates", "cid")


@query(_ladder_sql() + "SELECT outcome, method, count(*) AS n FROM answers GROUP BY outcome, method")
def lq1_histogram(spark, d):
    return _answers(spark, d).groupBy("outcome", "method").agg(F.count("*").alias("n"))


@query(_ladder_sql(ns="CASE WHEN l.event_id % 13 = 0 THEN NULL ELSE l.ns END") + ANSWERS)
def reconcile_no_namespace(spark, d):
    return _answers(spark, d, records=bound(spark, d, "ledger").withColumn("ns", F.when(F.col("event_id") % 13 != 0, F.col("ns"))))


@query(_ladder_sql(True) + ANSWERS)
def reconcile_idempotent(spark, d):
    return _answers(spark, d, True)


@query(with_sql("ledger", "claims", "population") + """ SELECT cid, c.ns, CASE WHEN complete AND t0 - interval '365 days' >= started_at AND t1 + interval '365 days' <= stopped_at AND indep THEN 'contradicted' ELSE 'not_assessable' END AS outcome
    FROM claims c JOIN population p ON p.ns = c.ns WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = c.event_id)""")
def lq5_absent_claims(spark, d):
    records = bound(spark, d, "ledger")
    declared = records.where("ns <> 'P' or event_id % 10 <> 0").select("ns", "event_id")  # P's declaration leaves ids out
    return R.absent_claims(by_event(spark, d, "claims"), records, bound(spark, d, "population"), declared=declared)


@query(with_sql("ledger", "claims") + """, x AS (SELECT cid, c.event_id, indep, CASE WHEN token_sha IS NULL THEN 'unavailable' WHEN token IS NULL THEN 'unbound' WHEN sha256(token) = token_sha THEN 'bound' ELSE 'mismatch' END AS bind FROM claims c JOIN ledger l ON l.event_id = c.event_id)
    SELECT cid, event_id, bind, CASE WHEN bind = 'mismatch' AND indep THEN 'contradicted' ELSE 'ambiguous' END AS outcome FROM x WHERE bind IN ('mismatch', 'unbound')""")
def lq5_binding_checks(spark, d):
    return R.binding_checks(by_event(spark, d, "claims"), by_event(spark, d, "ledger"))


@query(with_sql("tools", "execs") + """ SELECT tool, exec, CASE WHEN exec IS NULL THEN 'no_pair' WHEN t.cmd <> e.cmd THEN 'unmatched' WHEN t.output IS NULL OR e.output IS NULL THEN 'not_assessable' WHEN t.output = e.output THEN 'supported' ELSE 'contradicted' END AS outcome
    FROM tools t LEFT JOIN execs e ON t.transcript = e.transcript AND e.t >= t.t0 - interval '12 hours' AND e.t <= t.t1 + interval '12 hours'""")
def corroborate_pairs(spark, d):
    return R.corroborate(bound(spark, d, "tools"), bound(spark, d, "execs"))


@query(with_sql("revs") + " SELECT a.rev, b.rev AS parent FROM revs a JOIN revs b ON a.diff_base = b.rev AND a.page = b.page")
def lineage_built_on(spark, d):
    return L.built_on(based_revisions(spark, d, "page"))


@query("""WITH t AS (SELECT doc_id AS rev, CASE WHEN doc_id % 5 = 0 THEN concat('  ', text, ' ') ELSE text END AS text FROM documents),
    x AS (SELECT rev, sha256(text) AS exact, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS loose FROM t),
    e AS (SELECT rev, min(rev) OVER (PARTITION BY exact) AS first FROM x), l AS (SELECT rev, min(rev) OVER (PARTITION BY loose) AS first FROM x)
    SELECT rev, first, 'exact_bytes' AS method FROM e WHERE rev > first UNION ALL
    SELECT rev, first, 'normalised' AS method FROM l WHERE rev > first AND NOT EXISTS (SELECT 1 FROM e WHERE e.rev = l.rev AND e.first = l.first)""")
def lineage_reproduced(spark, d):
    docs = table(spark, d, "documents")
    return L.reproduced(docs.select(F.col("doc_id").alias("rev"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text")).alias("text")))


@query(with_sql("revs") + ", x AS (SELECT label, rev, min(rev) OVER (PARTITION BY label) AS first FROM revs WHERE trim(label) <> '') SELECT label, first, rev AS other FROM x WHERE rev > first")
def identity_labels(spark, d):
    return L.label_star(bound(spark, d, "revs"), "label", "rev")


@query(with_sql("revs") + ", x AS (SELECT DISTINCT ip16, label FROM revs), y AS (SELECT ip16, label, min(label) OVER (PARTITION BY ip16) AS first FROM x) SELECT first, label AS other, min(ip16) AS prefix FROM y WHERE label > first GROUP BY first, label")
def identity_prefixes(spark, d):
    return L.prefix_star(bound(spark, d, "revs"))


@query(with_sql("ranges") + """, t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9][0-9.]*[0-9]')) AS ip FROM documents),
    p AS (SELECT DISTINCT doc_id, CAST(split_part(ip, '.', 1) AS BIGINT) AS a, CAST(split_part(ip, '.', 2) AS BIGINT) AS b FROM t WHERE regexp_full_match(ip, '[0-9]{1,3}([.][0-9]{1,3}){3}')),
    ips AS (SELECT doc_id || '/' || a || '.' || b AS span_id, a * 16777216 + b * 65536 AS lo FROM p WHERE a < 256 AND b < 256)
    SELECT span_id, list, count(*) AS n, min(range_id) AS first FROM ips JOIN ranges r ON ips.lo <= r.hi AND r.lo <= ips.lo + 65535 GROUP BY span_id, list""")
def prefix_overlap(spark, d):
    """Every /16 that a text names, with the networks that overlap it."""
    ips = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9][0-9.]*[0-9]"), F.lit(0))).alias("ip"))
    part = lambda k: F.split_part("ip", F.lit("."), F.lit(k)).cast("long")
    ips = ips.where(F.col("ip").rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$")).select("doc_id", part(1).alias("a"), part(2).alias("b")).distinct().where("a < 256 and b < 256")
    name = F.concat(F.col("doc_id").cast("string"), F.lit("/"), F.col("a").cast("string"), F.lit("."), F.col("b").cast("string"))
    spans = ips.select(name.alias("span_id"), (F.col("a") * 16777216 + F.col("b") * 65536).alias("lo")).withColumn("hi", F.col("lo") + 65535)
    return L.range_overlap(spans, bound(spark, d, "ranges"))


@query(with_sql("revs") + """ SELECT wiki, count(*) AS n, count(DISTINCT page) AS pages, count(DISTINCT label) AS labels, min(t) AS first_t, max(t) AS last_t,
    count(*) FILTER (grade = 'reqlog') AS reqlog, count(*) FILTER (grade = 'rclog') AS rclog, count(*) FILTER (grade = 'write_date') AS write_date FROM revs GROUP BY wiki""")
def activity(spark, d):
    r, grade = bound(spark, d, "revs"), lambda g: F.count_if(F.col("grade") == g).alias(g)
    return r.groupBy("wiki").agg(F.count("*").alias("n"), F.countDistinct("page").alias("pages"), F.countDistinct("label").alias("labels"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), grade("reqlog"), grade("rclog"), grade("write_date"))


@query(with_sql("revs") + " SELECT coalesce(label, 'unclassified') AS family, count(DISTINCT page) AS pages, count(*) AS revisions, CAST(sum(body_len) AS BIGINT) AS body FROM revs GROUP BY 1")
def families(spark, d):
    return bound(spark, d, "revs").groupBy(F.coalesce("label", F.lit("unclassified")).alias("family")).agg(F.countDistinct("page").alias("pages"), F.count("*").alias("revisions"), F.sum("body_len").alias("body"))


@query(with_sql("revs") + " SELECT wiki, grade, count(*) AS n FROM revs GROUP BY wiki, grade")
def limits(spark, d):
    return bound(spark, d, "revs").groupBy("wiki", "grade").agg(F.count("*").alias("n"))


@query("SELECT doc_id % 8 AS file, count(*) AS n, doc_id % 8 <> 3 OR count(*) < 2 AS ordered FROM documents GROUP BY 1")
def ordered_check(spark, d):
    """Whether the ids of each file ascend by line; one file was written backwards.  Neighbouring lines meet by an
    equi-join on their numbers, so no file is sorted as a whole."""
    path, file = files.scratch(spark, "ordered"), F.col("doc_id") % 8
    rows = table(spark, d, "documents").select(file.alias("file"), "doc_id").repartition("file")
    rows.sortWithinPartitions("file", F.when(F.col("file") == 3, -F.col("doc_id")).otherwise(F.col("doc_id"))).select("file", F.col("doc_id").cast("string").alias("value")).write.partitionBy("file").text(path)
    x = files.cited_lines(spark, path).select("file", F.col("line").cast("long").alias("line"), F.col("text").cast("long").alias("id"))
    before = x.select("file", (F.col("line") + 1).alias("line"), F.col("id").alias("prev"))
    y = x.join(before, ["file", "line"], "left").groupBy("file").agg(F.count("*").alias("n"), (F.count_if(F.col("prev") > F.col("id")) == 0).alias("ordered"))
    return y.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), "n", "ordered")


@query(with_sql("refreshes", "reads") + """, f AS (SELECT min(ts) AS t FROM refreshes), c AS (SELECT digest, min(ts) AS t FROM refreshes GROUP BY digest)
    SELECT read_id, status, CASE WHEN status = 403 THEN 'denied' WHEN c.t < r.ts THEN 'supported' ELSE 'unmatched' END AS outcome FROM reads r CROSS JOIN f LEFT JOIN c ON c.digest = r.digest WHERE r.ts > f.t""")
def exposure(spark, d):
    refreshes, reads = bound(spark, d, "refreshes"), bound(spark, d, "reads")
    since = refreshes.agg(F.min("ts").alias("since"))
    commits = refreshes.groupBy("digest").agg(F.min("ts").alias("committed"))
    x = reads.join(F.broadcast(since), F.col("ts") > F.col("since")).join(commits, "digest", "left")  # one row
    return x.select("read_id", "status", F.when(F.col("status") == 403, "denied").when(F.col("committed") < F.col("ts"), "supported").otherwise("unmatched").alias("outcome"))


@query("""SELECT user_id AS transcript, max_by(event_id, struct_pack(a := ts, b := event_id)) AS final_event, max(ts) AS final_ts, count(*) AS considered FROM events GROUP BY user_id""")
def final_event(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("transcript")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("final_event"), F.max("ts").alias("final_ts"), F.count("*").alias("considered"))


_TRUTH = "WITH x AS (SELECT l.quality AS truth, CASE WHEN d.n_chars >= 400 THEN 1 ELSE 0 END AS pred, d.doc_id, CASE WHEN d.n_chars >= 400 THEN 0.9 ELSE 0.2 END AS p, d.n_chars, d.lang, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id) "


def _truth(spark, d):
    x = table(spark, d, "labels").join(table(spark, d, "documents").drop("text"), "doc_id")
    long = F.col("n_chars") >= 400
    return x.select(F.col("quality").alias("truth"), F.when(long, 1).otherwise(0).alias("pred"), "doc_id", F.when(long, 0.9).otherwise(0.2).alias("p"), "n_chars", "lang", "source")


@query(_TRUTH + "SELECT truth, pred, count(*) AS n FROM x GROUP BY truth, pred")
def eval_confusion(spark, d):
    return E.confusion(_truth(spark, d))


@query(_TRUTH + """, y AS (SELECT truth AS label, 1 AS t, 0 AS p, CAST(truth = pred AS INT) AS h FROM x UNION ALL SELECT pred, 0, 1, 0 FROM x)
    SELECT label, CASE WHEN sum(p) > 0 THEN CAST(sum(h) AS DOUBLE) / sum(p) END AS precision, CASE WHEN sum(t) > 0 THEN CAST(sum(h) AS DOUBLE) / sum(t) END AS recall, CAST(sum(t) AS BIGINT) AS support FROM y GROUP BY label""")
def eval_classes(spark, d):
    return E.class_scores(_truth(spark, d))


@query(_TRUTH + """SELECT coalesce(lang, 'all') AS slice, count(*) AS n, count(*) FILTER (truth = pred) AS correct, round(avg(2 * (p - truth) * (p - truth)), 9) AS brier,
    round(avg(-ln(greatest(CASE WHEN truth = 1 THEN p ELSE 1 - p END, 0.000001))), 9) AS log_loss FROM x GROUP BY GROUPING SETS ((lang), ())""")
def eval_calibration(spark, d):
    x = _truth(spark, d)
    gap = F.col("p") - F.col("truth")
    loss = -F.log(F.greatest(F.when(F.col("truth") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-6)))
    s = x.groupingSets([["lang"], []], "lang").agg(F.count("*").alias("n"), F.count_if(F.col("truth") == F.col("pred")).alias("correct"), F.round(F.avg(2 * gap * gap), 9).alias("brier"), F.round(F.avg(loss), 9).alias("log_loss"))
    return s.select(F.coalesce("lang", F.lit("all")).alias("slice"), "n", "correct", "brier", "log_loss")


@query(_TRUTH + """, r AS (SELECT source, truth, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, sum(truth) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS hits FROM x)
    SELECT source, count(*) AS ranked, CAST(sum(truth) AS BIGINT) AS relevant, round(CASE WHEN sum(truth) > 0 THEN sum(CASE WHEN truth = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0 END) / sum(truth) END, 9) AS average_precision,
    """ + "".join(f"count(*) FILTER (truth = 1 AND rank <= {k}) / {k}.0::DOUBLE AS p_at_{k}, round(CASE WHEN sum(truth) > 0 THEN CAST(count(*) FILTER (truth = 1 AND rank <= {k}) AS DOUBLE) / sum(truth) END, 9) AS r_at_{k}, " for k in (3, 5, 10)) + """CASE WHEN min(rank) FILTER (truth = 1) IS NULL THEN 0 ELSE 1.0::DOUBLE / min(rank) FILTER (truth = 1) END AS reciprocal_rank FROM r GROUP BY source""")
def eval_ranking(spark, d):
    x = _truth(spark, d).select("source", "truth", "n_chars", "doc_id")
    return ordered.ranking_scores(x, "source", "truth", [F.desc("n_chars"), F.col("doc_id")])


@query(_ladder_sql() + "SELECT event_id % 10 AS part, count(*) FILTER (outcome <> 'not_assessable') AS n, count(*) FILTER (outcome = 'supported') AS k, count(*) FILTER (outcome = 'not_assessable') AS excluded, CAST(count(*) FILTER (outcome = 'supported') AS DOUBLE) / count(*) FILTER (outcome <> 'not_assessable') AS estimate FROM answers GROUP BY 1")
def coverage_records(spark, d, answers=None):
    return E.record_coverage(lq1_attribution(spark, d, answers).withColumn("part", F.col("event_id") % 10), "part")


@query()
def coverage_intervals(spark, d):
    return E.proportion_interval(coverage_records(spark, d), "part")


@query(with_sql("ledger", "claims") + ", a AS (SELECT DISTINCT event_id FROM ledger), b AS (SELECT DISTINCT event_id FROM claims), n AS (SELECT (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b, (SELECT count(*) FROM a JOIN b USING (event_id)) AS m) SELECT a, b, m, round((a + 1) * (b + 1) / CAST(m + 1 AS DOUBLE) - 1, 3) AS estimate FROM n")
def capture_recapture(spark, d):
    seen = lambda n, c: bound(spark, d, n).select("event_id").distinct().withColumn(c, F.lit(1))
    both = seen("ledger", "a").join(seen("claims", "b"), "event_id", "full_outer")
    return E.chapman(both.agg(F.count("a").alias("a"), F.count("b").alias("b"), F.count(F.col("a") + F.col("b")).alias("m")))


@query(_ladder_sql() + """, truth AS (SELECT event_id, min(cid) AS expected FROM claims WHERE token IS NOT NULL AND token <> 'forged' GROUP BY event_id),
    s AS (SELECT a.*, t.expected FROM answers a LEFT JOIN truth t ON t.event_id = a.event_id)
    SELECT count(*) AS records, count(*) FILTER (outcome = 'supported') AS supported, count(*) FILTER (cid = expected) AS correct, count(*) FILTER (cid IS DISTINCT FROM expected AND outcome = 'supported') AS confident_errors,
    CAST(count(*) FILTER (cid = expected) AS DOUBLE) / nullif(count(*) FILTER (outcome = 'supported'), 0) AS precision, CAST(count(*) FILTER (cid = expected) AS DOUBLE) / nullif(count(expected), 0) AS recall,
    1 - CAST(count(*) FILTER (outcome = 'supported') AS DOUBLE) / count(*) AS abstention FROM s""")
def score_attribution(spark, d):
    truth = bound(spark, d, "claims").where("token is not null and token <> 'forged'").groupBy("event_id").agg(F.min("cid").alias("expected"))
    s = _answers(spark, d).join(truth, "event_id", "left")
    sup, ok = F.count_if(F.col("outcome") == "supported"), F.count_if(F.col("cid") == F.col("expected"))
    double = lambda c: c.cast("double")
    return s.agg(F.count("*").alias("records"), sup.alias("supported"), ok.alias("correct"), F.count_if((F.col("outcome") == "supported") & ~F.col("cid").eqNullSafe(F.col("expected"))).alias("confident_errors"), F.try_divide(double(ok), double(sup)).alias("precision"), F.try_divide(double(ok), double(F.count("expected"))).alias("recall"), (1 - F.try_divide(double(sup), double(F.count("*")))).alias("abstention"))


@query(with_sql("claims", "ledger") + """, x AS (SELECT transcript, event_id % 4 <> 0 AS flagged, event_id IN (SELECT event_id FROM ledger) AS real FROM (SELECT DISTINCT transcript, event_id FROM claims))
    SELECT transcript, count(*) FILTER (flagged AND real) AS tp, count(*) FILTER (flagged AND NOT real) AS fp, count(*) FILTER (NOT flagged AND real) AS fn FROM x GROUP BY transcript""")
def scanner_score(spark, d):
    x = bound(spark, d, "claims").select("transcript", "event_id").distinct().join(bound(spark, d, "ledger").select("event_id", F.lit(True).alias("real")), "event_id", "left")
    flag, real = F.col("event_id") % 4 != 0, F.coalesce("real", F.lit(False))
    return x.groupBy("transcript").agg(F.count_if(flag & real).alias("tp"), F.count_if(flag & ~real).alias("fp"), F.count_if(~flag & real).alias("fn"))


@query("SELECT count(*) AS messages, count(DISTINCT sha256(text)) AS requests, count(*) - count(DISTINCT sha256(text)) AS shared FROM conversations WHERE role IN ('user', 'assistant', 'tool') AND trim(text) <> ''")
def distinct_requests(spark, d):
    x = table(spark, d, "conversations").where("role in ('user', 'assistant', 'tool') and trim(text) <> ''").select(F.sha2("text", 256).alias("request"))
    once = x.groupBy("request").agg(F.count("*").alias("m"))
    return once.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("messages"), F.count("*").alias("requests"), (F.coalesce(F.sum("m"), F.lit(0)) - F.count("*")).alias("shared"))


@query("""SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, substr(text, 1, 160) || CASE WHEN length(text) > 160 THEN '…' ELSE '' END AS excerpt
    FROM conversations WHERE role IN ('user', 'assistant', 'tool') AND trim(text) <> ''""")
def triage_scope(spark, d):
    x = table(spark, d, "conversations").where("role in ('user', 'assistant', 'tool') and trim(text) <> ''")
    excerpt = F.concat(F.substring("text", 1, 160), F.when(F.length("text") > 160, "…").otherwise(""))
    return x.select("conv_id", "turn", "role", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("position"), excerpt.alias("excerpt"))


@query("""SELECT 'ref-' || substr(sha256('documents' || chr(0) || '' || chr(0) || 'row' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 32) AS citation_id, doc_id, sha256(text) AS sha256, substr(text, 1, 160) AS preview FROM documents""")
def citations(spark, d):
    key = F.concat_ws("\0", F.lit("documents"), F.lit(""), F.lit("row"), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select(F.concat(F.lit("ref-"), F.substring(F.sha2(key, 256), 1, 32)).alias("citation_id"), "doc_id", F.sha2("text", 256).alias("sha256"), F.substring("text", 1, 160).alias("preview"))


def _redact_sql() -> str:
    n, out = "0", "text"
    for pattern, by in ((redaction.ASSIGNMENT, r"\1\2[redacted]"), (redaction.BEARER, r"\1[redacted]"), (redaction.KEY_SHAPES, "[redacted]")):
        p = pattern.replace("'", "''")
        n, out = f"{n} + len(regexp_extract_all({out}, '{p}'))", f"regexp_replace({out}, '{p}', '{by}', 'g')"
    return f"SELECT doc_id, sha256({out}) AS redacted_sha256, CAST({n} AS BIGINT) AS n FROM documents"


@query(_redact_sql())
def redact(spark, d):
    x = table(spark, d, "documents").select("doc_id", redaction.redacted(F.col("text")).alias("r"))
    return x.select("doc_id", F.sha2("r.text", 256).alias("redacted_sha256"), "r.n")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"k": ' || event_id || ', "auth": {"api_token": "[redacted]", "note": "password=[redacted]"}, "cookies": "[redacted]"}'
    WHEN 1 THEN 'Authorization: Bearer [redacted] and [redacted]' ELSE '{"api_token": "abc", not JSON' END AS text, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END::BIGINT AS n FROM events""")
def redact_json(spark, d):
    """Secrets by the names of JSON members (0), as bearer tokens and keys by shape (1); a text that only looks like JSON (2)."""
    k = F.col("event_id")
    i = k.cast("string")
    member = F.concat(F.lit('{"k": '), i, F.lit(', "auth": {"api_token": "abc'), i, F.lit('", "note": "password=hunter'), i, F.lit('"}, "cookies": ["a", "'), i, F.lit('"]}'))
    bearer = F.concat(F.lit("Authorization: Bearer abcdefgh"), i, F.lit(" and sk-abcdefghijklmnopqrstuvwxyz"), i)
    text = F.when(k % 3 == 0, member).when(k % 3 == 1, bearer).otherwise('{"api_token": "abc", not JSON')
    return table(spark, d, "events").select(k, redaction.redacted(text).alias("r")).select("event_id", "r.text", "r.n")


@query("""WITH q AS (SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words FROM documents),
    s AS (SELECT doc_id, len(list_intersect(words, ['the', 'of', 'and', 'que', 'der'])) / 5.0::DOUBLE AS overlap FROM q)
    SELECT doc_id, least(3, CAST(round_even(overlap * 3 + 0.49, 0) AS INT)) AS level, row_number() OVER (ORDER BY overlap DESC, doc_id) AS rank FROM s QUALIFY rank <= 100""")
def search_rank(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    topic = F.array(*map(F.lit, ("the", "of", "and", "que", "der")))
    s = table(spark, d, "documents").select("doc_id", (F.size(F.array_intersect(words, topic)) / F.lit(5.0)).alias("overlap"))
    top = s.orderBy(F.desc("overlap"), "doc_id").limit(100)
    return top.select("doc_id", F.least(F.lit(3), F.bround(F.col("overlap") * 3 + 0.49, 0).cast("int")).alias("level"), F.row_number().over(Window.orderBy(F.desc("overlap"), "doc_id")).alias("rank"))


@query(with_sql("ledger") + """ SELECT 'ns' AS facet, ns AS value, count(*) AS n FROM ledger GROUP BY ns UNION ALL SELECT 'name', name, count(*) FROM ledger GROUP BY name""")
def facets(spark, d):
    x = bound(spark, d, "ledger").groupingSets([["ns"], ["name"]], "ns", "name").agg(F.grouping("ns").alias("g"), F.count("*").alias("n"))
    return x.select(F.when(F.col("g") == 0, "ns").otherwise("name").alias("facet"), F.when(F.col("g") == 0, F.col("ns")).otherwise(F.col("name")).alias("value"), "n")


@query(with_sql("ledger", "claims") + """ SELECT 'orphan_claims' AS check_name, count(*) AS n FROM claims c WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.event_id = c.event_id)
    UNION ALL SELECT 'duplicate_claims', count(*) - count(DISTINCT cid) FROM claims UNION ALL SELECT 'duplicate_records', count(*) - count(DISTINCT event_id) FROM ledger""")
def integrity(spark, d):
    ledger, claims = bound(spark, d, "ledger"), bound(spark, d, "claims")
    twice = lambda df, c, name: df.groupBy(c).agg(F.count("*").alias("m")).agg(F.lit(name).alias("check_name"), F.coalesce(F.sum(F.col("m") - 1), F.lit(0)).alias("n"))
    orphans = claims.join(ledger, "event_id", "left_anti").agg(F.lit("orphan_claims").alias("check_name"), F.count("*").alias("n"))
    return orphans.unionByName(twice(claims, "cid", "duplicate_claims")).unionByName(twice(ledger, "event_id", "duplicate_records"))


@query(_ladder_sql() + "SELECT l.name, l.event_id, l.ts, lag(l.event_id) OVER (PARTITION BY l.name ORDER BY l.ts, l.event_id) AS previous, CASE WHEN a.outcome = 'supported' THEN c.transcript END AS transcript, a.outcome FROM ledger l LEFT JOIN answers a ON a.event_id = l.event_id LEFT JOIN (SELECT cid, any_value(transcript) AS transcript FROM claims GROUP BY cid) c ON c.cid = a.cid")
def version_history(spark, d, answers=None):
    """answers: those of _answers() with the transcript of their claim, which the ladder has at hand."""
    ledger, answers = bound(spark, d, "ledger"), answers if answers is not None else _answers(spark, d, told=("transcript",))
    history = ordered.ranked(ledger.select("name", "event_id", "ts"), ["name"], [F.col("ts"), F.col("event_id")], previous={"previous": "event_id"})
    x = history.join(answers.select("event_id", "outcome", "transcript"), "event_id", "left")
    return x.select("name", "event_id", "ts", "previous", "transcript", "outcome")


@query(with_sql("revs") + ", p AS (SELECT label, count(*) AS stored, max(body_len) AS denominator FROM revs GROUP BY label) SELECT label, stored, denominator, CAST(stored AS DOUBLE) / denominator AS retention FROM p WHERE denominator > 0 AND stored <= denominator")
def retention(spark, d):
    p = bound(spark, d, "revs").groupBy("label").agg(F.count("*").alias("stored"), F.max("body_len").alias("denominator"))
    return p.where("denominator > 0 and stored <= denominator").withColumn("retention", F.col("stored").cast("double") / F.col("denominator"))


_MESSAGES = "SELECT conv_id, turn, role, text, turn % 3 = 0 AS calls FROM conversations"


def _label_sql() -> str:
    has = lambda p: "regexp_matches(text, '" + p.replace("'", "''") + "')"
    truthy = lambda k: f"coalesce(CASE WHEN json_valid(text) THEN json_extract_string(text, '$.{k}') END, '') NOT IN ('', 'false', '0')"
    said = " ".join(f"WHEN {has(p)} THEN '{label}'" for label, p in triage.CASCADE.items())
    return f"""SELECT conv_id, turn, role, lower(text) AS haystack, CASE WHEN role = 'tool' THEN CASE WHEN NOT calls THEN 'no_write_claim' WHEN {has(triage.FAILED)} THEN 'reports_failed_write'
        WHEN {truthy('accepted')} OR {truthy('event_id')} THEN 'claims_completed_write' ELSE 'insufficient_context' END
        WHEN {has(triage.CUT_SHORT)} THEN 'insufficient_context' WHEN NOT {has(triage.MENTIONS)} AND NOT calls THEN 'no_write_claim' {said} WHEN calls THEN 'plans_write' ELSE 'no_write_claim' END AS label
        FROM (SELECT conv_id, turn, role, coalesce(text, '') AS text, calls FROM ({_MESSAGES}))"""


def _labelled(spark, d):
    x = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return x.select("conv_id", "turn", "role", F.lower("text").alias("haystack"), triage.write_claim(F.col("role"), F.col("text"), F.col("turn") % 3 == 0).alias("label"))


@query(f"SELECT conv_id, turn, label FROM ({_label_sql()})")
def write_claim_labels(spark, d):
    return _labelled(spark, d).select("conv_id", "turn", "label")


@query(f"SELECT conv_id, turn, role, label FROM ({_label_sql()}) WHERE role = 'user' AND label <> 'insufficient_context' AND contains(haystack, 'the')")
def queue_filter(spark, d):
    return _labelled(spark, d).where("role = 'user' and label <> 'insufficient_context' and contains(haystack, 'the')").select("conv_id", "turn", "role", "label")


@query("""WITH q AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words FROM documents),
    s AS (SELECT doc_id, 3 * len(list_intersect(words, ['the', 'of', 'and', 'que', 'der'])) / 5.0::DOUBLE AS score, CASE WHEN len(words) >= 50 THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS confidence FROM q)
    SELECT doc_id, CASE WHEN score IS NULL THEN 'unscored' WHEN score >= 1.5 THEN 'review' WHEN score >= 0.5 AND confidence < 0.5 THEN 'uncertain' ELSE 'background' END AS disposition FROM s""")
def search_dispositions(spark, d):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    score = F.when(F.col("text").isNotNull(), 3 * F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "of", "and", "que", "der"))))) / F.lit(5.0))
    confidence = F.when(F.size(words) >= 50, 0.8).otherwise(0.4)
    return table(spark, d, "documents").select("doc_id", triage.search_disposition(score, confidence).alias("disposition"))


@query(with_sql("ledger", "population") + """, m AS (SELECT ns, count(*) AS measured FROM ledger WHERE token_sha IS NOT NULL OR ns <> 'P' GROUP BY ns)
    SELECT p.ns AS name, p.n AS published, m.measured, CASE WHEN NOT p.complete THEN 'not_computable' WHEN p.n = m.measured THEN 'exact' ELSE 'differs' END AS status FROM population p LEFT JOIN m ON m.ns = p.ns""")
def fact_audit(spark, d):
    m = bound(spark, d, "ledger").where("token_sha is not null or ns <> 'P'").groupBy("ns").agg(F.count("*").alias("measured"))
    status = F.when(~F.col("complete"), "not_computable").when(F.col("n") == F.col("measured"), "exact").otherwise("differs")
    return bound(spark, d, "population").join(m, "ns", "left").select(F.col("ns").alias("name"), F.col("n").alias("published"), "measured", status.alias("status"))


@query("""SELECT sha256(text) AS sha, count(*) AS copies, count(DISTINCT source) AS domains, CASE WHEN count(DISTINCT source) > 1 THEN 'rejected' WHEN count(*) > 1 THEN 'repeated' ELSE 'accepted' END AS status
    FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)""")
def trust_domains(spark, d):
    x = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("sha"), "source").agg(F.count("*").alias("m"))  # a hot text is pre-aggregated
    y = x.groupBy("sha").agg(F.sum("m").alias("copies"), F.count("source").alias("domains"))
    return y.withColumn("status", F.when(F.col("domains") > 1, "rejected").when(F.col("copies") > 1, "repeated").otherwise("accepted"))


@query("""WITH a AS (SELECT sha256(q.text) AS request, min(r.text) AS answer FROM conversations q JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 WHERE q.role = 'user' AND r.role = 'assistant' GROUP BY 1)
    SELECT c.conv_id, c.turn, CASE WHEN a.answer IS NULL THEN 'unavailable' ELSE 'replayed' END AS status, sha256(a.answer) AS answer_sha FROM conversations c LEFT JOIN a ON a.request = sha256(c.text) WHERE c.role = 'user'""")
def replay(spark, d):
    c = table(spark, d, "conversations").withColumn("request", F.sha2("text", 256))
    r = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = c.where("role = 'user'").select("conv_id", "turn", "request")
    a = asked.join(r, ["conv_id", "turn"]).where("request is not null").groupBy("request").agg(F.min("answer").alias("answer"))
    return asked.join(a, "request", "left").select("conv_id", "turn", F.when(F.col("answer").isNull(), "unavailable").otherwise("replayed").alias("status"), F.sha2("answer", 256).alias("answer_sha"))


@query(_ladder_sql() + """SELECT l.ns, count(*) AS records, count(*) FILTER (a.outcome = 'supported') AS supported, count(*) FILTER (c.event_id IS NOT NULL) AS accept_all
    FROM ledger l LEFT JOIN answers a ON a.event_id = l.event_id LEFT JOIN (SELECT DISTINCT event_id FROM claims) c ON c.event_id = l.event_id GROUP BY l.ns""")
def accept_all_control(spark, d):
    claimed = bound(spark, d, "claims").select("event_id").distinct().withColumn("claimed", F.lit(True))
    x = bound(spark, d, "ledger").select("ns", "event_id").join(_answers(spark, d).select("event_id", "outcome"), "event_id", "left").join(claimed, "event_id", "left")
    return x.groupBy("ns").agg(F.count("*").alias("records"), F.count_if(F.col("outcome") == "supported").alias("supported"), F.count("claimed").alias("accept_all"))


@query(_ladder_sql() + "SELECT l.event_id, l.name, a.outcome FROM ledger l JOIN answers a ON a.event_id = l.event_id WHERE a.outcome = 'supported' AND l.name ILIKE '%urgent%'")
def relation_browse(spark, d):
    x = bound(spark, d, "ledger").where(F.col("name").ilike("%urgent%")).select("event_id", "name")
    return x.join(_answers(spark, d).where("outcome = 'supported'").select("event_id", "outcome"), "event_id").select("event_id", "name", "outcome")
