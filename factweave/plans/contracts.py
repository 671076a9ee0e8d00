"""Queries over receipts, commands, populations, declarations and counts of the graph, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators import checks as C
from factweave.operators import lineage as L
from factweave.operators import receipts as R
from factweave.plans.bindings import based_revisions, bound, table, with_sql
from factweave.plans.catalogue import ORACLE_SQL, QUERIES, query
from factweave.sources import files, trace


def _through_json(spark, rows, name: str):
    """rows as a source would give them: written as JSON lines and read again."""
    path = files.scratch(spark, name)
    if trace.active:
        files.WRITTEN[path] = trace.columns_read(rows)
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("""SELECT o_orderkey AS event_id, o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AS well_formed,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN o_orderstatus END AS claim_ns,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 THEN o_orderpriority END AS claim_name FROM orders""")
def receipts(spark, d):
    """Write calls whose receipts are refused (5), digest other bytes (7), come from a truncated event (11), give another
    name (13) or a number for the event id (17), by divisors of the order's key."""
    k, payload = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    digest = F.when(k % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2(payload, 256))
    name = F.when(k % 13 == 0, F.lit("another")).otherwise(F.col("o_orderpriority"))
    event_id = F.when(k % 17 == 0, k.cast("string")).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"accepted": '), (k % 5 != 0).cast("string"), F.lit(', "namespace": "'), F.col("o_orderstatus"), F.lit('", "name": "'), name, F.lit('", "sha256": "'), digest, F.lit('", "event_id": '), event_id, F.lit("}"))
    rows = table(spark, d, "orders").select(k.alias("event_id"), F.lit("write").alias("function"), F.col("o_orderpriority").alias("name"), payload.alias("payload"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("namespace"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("pending"), (k % 11 == 0).alias("truncated"), text.alias("result"))
    x = _through_json(spark, rows, "tool-events")
    ok = R.well_formed({c: F.col(c) for c in ("function", "name", "payload", "namespace", "error", "pending", "truncated")}, F.col("result"), "write")
    x = x.withColumn("well_formed", ok).withColumn("key", R.claim_key(F.col("result"), F.col("well_formed")))
    return x.select("event_id", "well_formed", F.col("key.namespace").alias("claim_ns"), F.col("key.name").alias("claim_name"))


@query("SELECT event_id, 'job-' || event_id AS job, 'launched' AS kind, 'ambiguous' AS outcome FROM events WHERE event_type = 'signup' AND event_id % 4 <> 0 AND event_id % 9 <> 0")
def lq2_launches(spark, d):
    """Start calls whose receipt names a job; a receipt that says not started (4) or an error (9) launches none."""
    k = F.col("event_id")
    receipt = F.concat(F.lit('{"started": '), (k % 4 != 0).cast("string"), F.lit(', "job_id": "job-'), k.cast("string"), F.lit('"}'))
    x = _through_json(spark, table(spark, d, "events").where("event_type = 'signup'").select(k, F.when(k % 9 == 0, F.lit("timeout")).alias("error"), receipt.alias("result")), "starts")
    return x.withColumn("job", R.launched(F.col("error"), F.col("result"))).where("job is not null").select("event_id", "job", F.lit("launched").alias("kind"), F.lit("ambiguous").alias("outcome"))


@query(with_sql("ledger") + " SELECT event_id, ns, sha FROM ledger WHERE name = '1-URGENT'")
def lq3_named_outputs(spark, d, name: str = "1-URGENT"):
    return bound(spark, d, "ledger").where(F.col("name") == name).select("event_id", "ns", "sha")


_ATTESTED = "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN sha256(CAST(o_custkey AS VARCHAR)) ELSE sha256(CAST(o_custkey + 1 AS VARCHAR)) END"


@query(f"SELECT l_orderkey AS event_id, l_linenumber AS line, sha256(CAST(o_custkey AS VARCHAR)) = {_ATTESTED} AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 7 <> 0 AND l_linenumber % 3 <> 2")
def version_exclusion(spark, d):
    record = bound(spark, d, "ledger").select("event_id", "sha")
    version = F.when(F.col("l_linenumber") % 3 == 1, F.col("o_custkey")).when(F.col("l_linenumber") % 3 == 2, F.col("o_custkey") + 1)
    claim = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    claim = claim.select(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line"), F.sha2(version.cast("string"), 256).alias("attested"))
    return C.same_version(claim.join(record, "event_id")).select("event_id", "line", (F.col("sha") == F.col("attested")).alias("same"))


@query("""WITH r AS (SELECT o_orderstatus AS ns, o_orderkey AS event_id, o_custkey AS c FROM orders), s AS (SELECT ns, c, min(event_id) AS parent FROM r GROUP BY ns, c)
    SELECT event_id, parent FROM r JOIN s ON s.ns = r.ns AND s.c = r.c - 1""")
def previous_digests(spark, d):
    digest = lambda c: F.sha2(c.cast("string"), 256)
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("ns"), F.col("o_orderkey").alias("event_id"), digest(F.col("o_custkey")).alias("sha"), digest(F.col("o_custkey") - 1).alias("previous"))
    return C.previous_digest(o)


@query("SELECT DISTINCT conv_id || '/' || turn AS subject_key, CASE WHEN conv_id % 3 <> 0 THEN CAST(conv_id AS VARCHAR) END AS object_key FROM conversations")
def endpoint_resolution(spark, d):
    """Messages with the sessions they belong to; every third session is no known entity."""
    x = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("message"), "conv_id")
    known = files.nodes(x, "message", "message").unionByName(files.nodes(x.where("conv_id % 3 <> 0"), "session", "session"))
    return C.resolved(files.edges(x, "member_of", ("message", "message"), ("session", "session")), known).select("subject_key", "object_key")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def id_lookup(spark, d):
    """Entities of a set of ids, given as arrays."""
    ids = table(spark, d, "labels").where("toxic = 1").groupBy("quality", F.pmod(F.xxhash64("doc_id"), F.lit(64))).agg(F.collect_set("doc_id").alias("ids"))
    return table(spark, d, "documents").join(ids.select(F.explode("ids").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "lang", "source")


_SUGGESTED = "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 14 = 1"


@query(f"WITH n AS (SELECT doc_id, count(*) AS n FROM ({_SUGGESTED}) GROUP BY doc_id) SELECT l.doc_id, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'one' WHEN n > 1 THEN 'several' ELSE 'missing' END AS status FROM labels l LEFT JOIN n ON n.doc_id = l.doc_id")
def label_suggestions(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return C.matched(table(spark, d, "labels"), docs.where("doc_id % 3 <> 0").unionByName(docs.where("doc_id % 14 = 1")), "doc_id")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'unpublished' WHEN doc_id % 9 = 0 OR text IS NULL THEN 'differs' ELSE 'same' END AS status FROM documents")
def published_citations(spark, d):
    x = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    told = x.where("id % 4 <> 0").select("id", F.sha2(F.when(F.col("id") % 9 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return C.published(x.select("id", F.sha2("text", 256).alias("sha256")), told)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def event_population(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"SELECT 'shared_label' AS method, 'ambiguous' AS outcome, count(*) AS n FROM ({ORACLE_SQL['identity_labels']}) UNION ALL SELECT 'shared_prefix', 'ambiguous', count(*) FROM ({ORACLE_SQL['identity_prefixes']})")
def identity_counts(spark, d):
    revs = bound(spark, d, "revs")
    both = L.label_star(revs, "label", "rev").select(F.lit("shared_label").alias("method")).unionByName(L.prefix_star(revs).select(F.lit("shared_prefix").alias("method")))
    return both.groupBy("method", F.lit("ambiguous").alias("outcome")).agg(F.count("*").alias("n"))


@query(f"SELECT 'built_on' AS kind, 'diff_base' AS method, count(*) AS n FROM ({ORACLE_SQL['lineage_built_on']}) UNION ALL SELECT 'reproduced', method, count(*) FROM ({ORACLE_SQL['lineage_reproduced']}) GROUP BY method")
def lineage_counts(spark, d):
    a = QUERIES["lineage_built_on"](spark, d).select(F.lit("built_on").alias("kind"), F.lit("diff_base").alias("method"))
    b = QUERIES["lineage_reproduced"](spark, d).select(F.lit("reproduced").alias("kind"), "method")
    return a.unionByName(b).groupBy("kind", "method").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(sum(denominator) AS BIGINT) AS population, CAST(sum(stored) AS BIGINT) AS supported, count(*) AS rows FROM ({ORACLE_SQL['retention']})")
def retention_totals(spark, d):
    return QUERIES["retention"](spark, d).agg(F.sum("denominator").cast("long").alias("population"), F.sum("stored").cast("long").alias("supported"), F.count("*").alias("rows"))


@query("""WITH t AS (SELECT avg(CAST(l_returnflag = 'A' AS INT)) AS truth FROM lineitem), g AS (SELECT l_shipmode_, count(*) AS n, avg(CAST(a AS INT)) AS p FROM (SELECT l_suppkey % 7 AS l_shipmode_, l_returnflag = 'A' AS a FROM lineitem) GROUP BY 1)
    SELECT count(*) AS intervals, bool_and(truth BETWEEN p - 4 * sqrt(p * (1 - p) / n) AND p + 4 * sqrt(p * (1 - p) / n)) AS all_hold FROM g CROSS JOIN t""")
def intervals_hold_truth(spark, d):
    """Whether every slice's interval of four standard errors holds the fraction over all rows."""
    x = table(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("slice"), (F.col("l_returnflag") == "A").cast("int").alias("a"))
    truth = x.agg(F.avg("a").alias("truth"))  # one row
    g = x.groupBy("slice").agg(F.count("*").alias("n"), F.avg("a").alias("p")).join(F.broadcast(truth))
    half = 4 * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return g.agg(F.count("*").alias("intervals"), F.bool_and(F.col("truth").between(F.col("p") - half, F.col("p") + half)).alias("all_hold"))


@query(with_sql("revs") + ", f AS (SELECT label FROM revs WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) SELECT rev, label, t FROM revs WHERE label IN (SELECT label FROM f) ORDER BY t, rev LIMIT 5")
def busiest_family(spark, d):
    """The five earliest revisions of the family with the most."""
    r = bound(spark, d, "revs")
    top = r.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return r.join(top, "label", "left_semi").select("rev", "label", "t").orderBy("t", "rev").limit(5)


@query(f"""WITH x AS ({ORACLE_SQL['corroborate_pairs']}) SELECT tool, exec, outcome, (SELECT count(*) FROM x) AS total, (SELECT count(*) FROM x) > 60 AS truncated FROM x
    ORDER BY CASE outcome WHEN 'contradicted' THEN 0 WHEN 'supported' THEN 1 WHEN 'ambiguous' THEN 2 WHEN 'not_assessable' THEN 3 ELSE 4 END, tool, exec NULLS FIRST LIMIT 40 OFFSET 20""")
def relation_page(spark, d):
    """The second page of twenty, and the third, in the order of outcomes."""
    x = QUERIES["corroborate_pairs"](spark, d)
    return C.page(x, [C.outcome_rank(F.col("outcome")), F.col("tool"), F.col("exec").asc_nulls_first()], 20, 40)


@query(with_sql("revs") + """, e AS (SELECT rev, diff_base, body_sha FROM revs WHERE diff_base IS NOT NULL ORDER BY rev LIMIT 8)
    SELECT array_to_string(list_sort(list_distinct(flatten(list([CAST(rev AS VARCHAR), CAST(diff_base AS VARCHAR)])))), ',') AS citations FROM e""")
def integrity_citations(spark, d):
    """The citations of the eight first edges, once each and sorted."""
    e = based_revisions(spark, d).where("diff_base is not null").orderBy("rev").limit(8)
    each = e.select(F.explode(F.array(F.col("rev").cast("string"), F.col("diff_base").cast("string"))).alias("c"))
    return each.agg(F.array_join(F.array_sort(F.collect_set("c")), ",").alias("citations"))


@query("""WITH r AS (SELECT o_orderstatus AS ns, o_orderkey AS event_id FROM orders), p AS (SELECT * FROM r WHERE NOT (ns = 'P' AND event_id % 10 = 0) UNION ALL SELECT * FROM r WHERE ns = 'O' AND event_id % 100 = 1),
    a AS (SELECT ns, event_id, count(*) AS m FROM p GROUP BY 1, 2), x AS (SELECT ns, CAST(sum(m) AS BIGINT) AS n_declared, CAST(sum(m - 1) AS BIGINT) AS n_repeated FROM a GROUP BY ns)
    SELECT ns, n_declared, n_repeated, 0::BIGINT AS n_missing, (SELECT count(*) FROM r WHERE r.ns = x.ns AND NOT EXISTS (SELECT 1 FROM a WHERE a.ns = r.ns AND a.event_id = r.event_id)) AS n_undeclared, ns = 'F' AS complete FROM x""")
def population_status(spark, d):
    """Declared ids of every namespace against the records': P leaves ids out, O repeats some."""
    r = table(spark, d, "orders").select(F.col("o_orderstatus").alias("ns"), F.col("o_orderkey").alias("event_id"))
    declared = r.where("not (ns = 'P' and event_id % 10 = 0)").unionByName(r.where("ns = 'O' and event_id % 100 = 1"))
    declared = _through_json(spark, declared, "population")
    return C.population_status(declared, declared.groupBy("ns").agg(F.count("*").alias("n")), r)


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes, TRUE AS same FROM documents WHERE text IS NOT NULL")
def latin1_bodies(spark, d):
    """Bodies stored as one character for each byte, taken back to bytes and decoded."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("body"))
    raw = R.latin1_bytes(F.col("body"))
    return x.select("doc_id", F.sha2(raw, 256).alias("sha256"), F.octet_length(raw).cast("long").alias("n_bytes"), (F.decode(raw, "UTF-8") == F.col("text")).alias("same"))


@query("SELECT handle, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '([a-z]{9,})', 1)) AS handle FROM conversations WHERE role IN ('system', 'user')) GROUP BY handle")
def handle_mentions(spark, d, pattern: str = "([a-z]{9,})"):
    """Handles by the user's pattern, in what system and user say."""
    x = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "role", "text")
    return R.handles(x, pattern).groupBy("handle").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE 'echo ' || event_id || ' done' END AS command FROM events")
def commands(spark, d):
    """The command of tool arguments in several shapes, unwrapped and with single spaces."""
    k = F.col("event_id")
    body = F.concat(F.lit("echo  "), k.cast("string"), F.lit("   done"))
    shapes = F.when(k % 5 == 0, F.to_json(F.struct(body.alias("code")))).when(k % 5 == 1, F.to_json(F.struct(F.concat(F.lit("bash -lc '"), body, F.lit("'")).alias("cmd"))))
    shapes = shapes.when(k % 5 == 2, F.to_json(F.struct(F.concat(F.lit('/usr/bin/python3 -c "'), body, F.lit('"')).alias("command")))).when(k % 5 == 3, F.to_json(F.struct(F.concat(F.lit(" "), body, F.lit("\n")).alias("cmd"))))
    x = table(spark, d, "events").select(k, F.coalesce(shapes, F.lit('{"path": "x"}')).alias("arguments"))
    return x.select("event_id", R.normalised(R.unwrapped(R.command_argument(F.col("arguments")))).alias("command"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN NULL ELSE TRUE END AS same FROM documents")
def tolerant_outputs(spark, d):
    """Outputs that differ in blank lines (0), hold one another (1), differ (2), are empty (3) or begin alike (4)."""
    k = F.col("doc_id")
    line = lambda s: F.concat(k.cast("string"), F.lit(s))
    a = F.concat_ws("\n", line("a  "), F.lit(""), line("b"), line("c\r\n"), line("d"))
    b = F.when(k % 5 == 0, F.concat_ws("\n", line("a"), line("b"), line("c"), line("d"))).when(k % 5 == 1, F.concat_ws("\n", line("b"), line("c"))).when(k % 5 == 2, line("x")).when(k % 5 == 3, F.lit(" \n")).otherwise(F.concat_ws("\n", line("a"), line("b"), line("c"), line("e")))
    return table(spark, d, "documents").select("doc_id", R.same_output(a, b).alias("same"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS DOUBLE) - 7200 - event_id % 3 END AS lo,
    CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS DOUBLE) - 7200 + event_id % 3 END AS hi, event_id % 7 <> 0 AS zoned FROM events""")
def time_intervals(spark, d):
    """ISO times two hours ahead of UTC; without a zone (7) there is no interval, without an uncertainty (5) no bounds."""
    k = F.col("event_id")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 7 == 0, F.lit("")).otherwise(F.lit("+02:00")))
    x = table(spark, d, "events").select(k, R.interval(text, F.when(k % 5 != 0, (k % 3).cast("double"))).alias("i"))
    return x.select("event_id", F.col("i.lo").alias("lo"), F.col("i.hi").alias("hi"), F.col("i").isNotNull().alias("zoned"))


@query("SELECT doc_id % 4 AS kind, CASE WHEN doc_id % 4 < 2 THEN 'supported' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM documents GROUP BY 1, 2")
def family_confidence(spark, d):
    confidence = F.element_at(F.array(F.lit("high"), F.lit("0.8"), F.lit("0.79"), F.lit("low")), (F.col("doc_id") % 4 + 1).cast("int"))
    x = table(spark, d, "documents").select((F.col("doc_id") % 4).alias("kind"), R.family_outcome(confidence).alias("outcome"))
    return x.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (contains(text, '/')) AS slash, count(*) FILTER (contains(text, '~')) AS tilde, count(*) FILTER (NOT regexp_matches(text, '[^\\x00-\\x7F]')) AS ascii, count(*) FILTER (regexp_matches(text, '^(January|February|March|April|May|June|July|August|September|October|November|December)')) AS month FROM documents")
def text_predicates(spark, d):
    t = F.col("text")
    month = t.rlike("^(January|February|March|April|May|June|July|August|September|October|November|December)")
    return table(spark, d, "documents").agg(F.count_if(t.contains("/")).alias("slash"), F.count_if(t.contains("~")).alias("tilde"), F.count_if(~t.rlike(r"[^\x00-\x7F]")).alias("ascii"), F.count_if(month).alias("month"))


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 0.5 ELSE CAST(quality AS DOUBLE) END AS expected FROM labels")
def expectations(spark, d):
    """Answers as probabilities: one-hot where there is one, even where there is none; and their expectation."""
    q = F.col("quality")
    p = F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array(*(F.coalesce((q == k).cast("double"), F.lit(0.5)) for k in (0, 1))))
    return table(spark, d, "labels").select("doc_id", R.expected_score(p).alias("expected"))


@query("SELECT o_orderstatus AS ns, format('{:,} of {:,} records carry a commitment', count(*) FILTER (o_orderkey % 5 <> 0), count(*)) AS headline FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1")
def headlines(spark, d):
    g = bound(spark, d, "ledger").groupBy("ns").agg(F.count("token_sha").alias("k"), F.count("*").alias("n"))
    return g.select("ns", F.format_string("%,d of %,d records carry a commitment", "k", "n").alias("headline"))


@query("""WITH x AS (SELECT c_nationkey AS id, c_custkey % 30 AS related_to FROM customer), s AS (SELECT DISTINCT id FROM x)
    SELECT 'repeated' AS rule, count(*) AS n FROM (SELECT id, related_to FROM x GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'unknown', count(*) FROM x WHERE related_to NOT IN (SELECT id FROM s)
    UNION ALL SELECT 'one_sided', count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.id = x.related_to AND y.related_to = x.id)""")
def trust_declarations(spark, d):
    return C.declaration_violations(table(spark, d, "customer").select(F.col("c_nationkey").alias("id"), (F.col("c_custkey") % 30).alias("related_to")))


@query("""WITH e AS (SELECT l_orderkey AS object, count(*) AS n, count(DISTINCT l_suppkey % 3) AS m FROM lineitem GROUP BY 1)
    SELECT 'no_witness' AS rule, count(*) FILTER (object % 19 = 0) AS n FROM e UNION ALL SELECT 'no_citation', count(*) FILTER (object % 23 = 0) FROM e UNION ALL SELECT 'candidate_not_object', count(*) FILTER (object % 2 = 0 AND n > 1) FROM e
    UNION ALL SELECT 'actor_not_authenticated', count(*) FILTER (object % 2 = 1 AND object % 3 = 0) FROM e UNION ALL SELECT 'candidate_repeats', count(*) FILTER (m < n) FROM e""")
def relation_invariants(spark, d):
    """Edges of one order each: its lines are the candidates; odd ones speak of actors."""
    k = F.col("object")
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("object")).agg(F.collect_list(F.col("l_suppkey") % 3).alias("c"))
    one = F.when(F.size("c") == 1, F.array(k)).otherwise(F.col("c"))
    e = g.select(k, F.when(k % 2 == 0, "produced").otherwise("same_actor").alias("kind"), F.lit("supported").alias("outcome"), one.alias("candidates"), (k % 19).alias("n_witnesses"), (k % 23).alias("n_citations"), (k % 3 != 0).alias("authenticated"))
    return C.relation_violations(e)


@query(with_sql("ledger") + f" SELECT (SELECT count(*) FROM ledger) AS records, count(*) AS reconciled, count(*) = (SELECT count(*) FROM ledger) AS all_reconciled FROM ({ORACLE_SQL['lq1_attribution']})")
def all_reconciled(spark, d):
    """Whether every record has an answer, which coverage and scores ask for."""
    n = bound(spark, d, "ledger").agg(F.count("*").alias("records"))
    k = QUERIES["lq1_attribution"](spark, d).agg(F.count("*").alias("reconciled"))
    return n.join(F.broadcast(k)).withColumn("all_reconciled", F.col("records") == F.col("reconciled"))


@query(with_sql("revs", "ledger") + " SELECT q AS question FROM (VALUES ('DQ'), ('LQ')) v(q) WHERE CASE q WHEN 'DQ' THEN (SELECT count(*) FROM revs) > 0 ELSE (SELECT count(*) FROM ledger) > 0 OR (SELECT count(*) FROM revs) = 0 END")
def relevant_questions(spark, d):
    n = bound(spark, d, "revs").agg(F.count("*").alias("revs")).join(F.broadcast(bound(spark, d, "ledger").agg(F.count("*").alias("records"))))
    asked = F.filter(F.array(F.when(F.col("revs") > 0, F.lit("DQ")), F.when((F.col("records") > 0) | (F.col("revs") == 0), F.lit("LQ"))), lambda q: q.isNotNull())
    return n.select(F.explode(asked).alias("question"))


@query("SELECT p_partkey AS range_id, CASE p_partkey % 3 WHEN 0 THEN 'tags' WHEN 1 THEN 'prefixes' ELSE 'spans' END AS list, (p_partkey % 200) * 16777216 + (p_partkey % 250) * 65536 AS lo, (p_partkey % 200) * 16777216 + (p_partkey % 250) * 65536 + 65535 AS hi FROM part")
def reference_lists(spark, d):
    """Networks from lists of three JSON shapes: service tags, prefixes, and first and last addresses."""
    k = F.col("p_partkey")
    head = F.concat_ws(".", (k % 200).cast("string"), (k % 250).cast("string"))
    net, parts = F.concat(head, F.lit(".0.0/16")), table(spark, d, "part").withColumn("range_id", k)
    group = F.pmod(F.xxhash64("p_partkey"), F.lit(16))
    write = lambda rows, name, item, top: rows.groupBy(group).agg(F.collect_list(item).alias(top)).select(top)
    tags = write(parts.where(k % 3 == 0), "tags", F.struct(k.alias("id"), F.struct(F.array(net).alias("addressPrefixes")).alias("properties")), "values")
    prefixes = write(parts.where(k % 3 == 1), "prefixes", F.struct(k.alias("id"), net.alias("ipv4Prefix")), "prefixes")
    spans = write(parts.where(k % 3 == 2), "spans", F.struct(k.alias("id"), F.concat(head, F.lit(".0.0")).alias("startAddress"), F.concat(head, F.lit(".255.255")).alias("endAddress")), "spans")
    a = _through_json(spark, tags, "tags").select(F.inline("values")).select("id", F.lit("tags").alias("list"), F.explode("properties.addressPrefixes").alias("net"))
    b = _through_json(spark, prefixes, "prefixes").select(F.inline("prefixes")).select("id", F.lit("prefixes").alias("list"), F.col("ipv4Prefix").alias("net"))
    nets = a.unionByName(b)
    c = _through_json(spark, spans, "spans").select(F.inline("spans"))
    both = nets.select("id", "list", files.network("net").alias("r")).unionByName(c.select("id", F.lit("spans").alias("list"), F.struct(files.address("startAddress").alias("lo"), files.address("endAddress").alias("hi")).alias("r")))
    return both.select(F.col("id").alias("range_id"), "list", "r.lo", "r.hi")


@query("SELECT event_id AS read_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE sha256(props) END AS digest, CASE WHEN event_id % 9 = 0 THEN 403 ELSE 200 END AS status FROM events WHERE event_type = 'purchase'")
def src_read_log(spark, d):
    """A read log whose payloads give way to their digests; a denial has none."""
    k = F.col("event_id")
    rows = table(spark, d, "events").where("event_type = 'purchase'").select(k.alias("read_id"), F.when(k % 9 == 0, 403).otherwise(200).alias("status"), F.when(k % 9 != 0, F.col("props")).alias("payload"))
    return files.read_log(_through_json(spark, rows, "reads"))


@query("SELECT event_id AS refresh, sha256(props) AS digest FROM events WHERE event_type = 'signup' AND event_id % 13 <> 0")
def src_refresh_log(spark, d):
    """A refresh log; rows whose commitment is no SHA-256 digest are no commitments."""
    k = F.col("event_id")
    rows = table(spark, d, "events").where("event_type = 'signup'").select(k.alias("refresh"), F.when(k % 13 == 0, F.lit("none")).otherwise(F.sha2("props", 256)).alias("digest"))
    return files.refresh_log(_through_json(spark, rows, "refreshes"))
