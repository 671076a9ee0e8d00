"""Queries over sources, the graph, declarations, streams and reports; they join those of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factweave.operators import estimate as E
from factweave.operators import lineage as L
from factweave.operators import reconcile as R
from factweave.operators import resample, triage
from factweave.plans import catalogue as C
from factweave.plans import contracts  # noqa: F401  (the docket asks its queries)
from factweave.plans.bindings import based_revisions, bound, table, with_sql
from factweave.plans.catalogue import query
from factweave.sources import files
from factweave.streaming import live


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Sources: rows are written to the shared folder in the source's format and read back with their citations.


@query("""SELECT event_id % 16 AS file, event_id, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS line,
    sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":' || props || '}') AS sha256 FROM events""")
def jsonl_cited(spark, d):
    path = files.scratch(spark, "jsonl")
    body = F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"event_type":"'), "event_type", F.lit('","props":'), "props", F.lit("}"))
    rows = table(spark, d, "events").select((F.col("event_id") % 16).alias("file"), "event_id", body.alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "event_id").select("file", "value").write.partitionBy("file").text(path)
    x = files.cited_lines(spark, path)
    return x.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), files.json_fragment(F.col("text"), "$.event_id", "long").alias("event_id"), F.col("line").cast("long").alias("line"), "sha256")


@query("""SELECT event_id % 16 AS file, event_id, row_number() OVER (PARTITION BY event_id % 16 ORDER BY event_id) AS record,
    sha256('{"event_id":"' || event_id || '","props":"' || replace(props, '"', '\\"') || '\\n' || event_type || '"}') AS sha256 FROM events""")
def csv_cited(spark, d):
    path = files.scratch(spark, "csv")
    rows = table(spark, d, "events").select((F.col("event_id") % 16).alias("file"), "event_id", F.concat("props", F.lit("\n"), "event_type").alias("props"))
    rows.repartition("file").sortWithinPartitions("file", "event_id").write.partitionBy("file").options(header=True, quote='"', escape='"').csv(path)
    x = files.cited_csv(spark, path, "event_id long, props string")
    return x.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), "event_id", "record", "sha256")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, d):
    return table(spark, d, "events").select("event_id", files.json_fragment(F.col("props"), "$.k", "long").alias("k"))


@query()
def file_inventory(spark, d):
    return files.inventory(spark, f"{d}/*.parquet")


@query()
def file_verify(spark, d):
    """The inventory against a manifest that names one file that is gone and has one wrong digest."""
    found = files.inventory(spark, f"{d}/*.parquet")
    listed = found.withColumn("sha256", F.when(F.col("name") != "nation.parquet", F.col("sha256")).otherwise("0")).where("name <> 'region.parquet'")
    return files.verify(found, listed.withColumn("name", F.when(F.col("name") == "part.parquet", "parts.parquet").otherwise(F.col("name"))))


@query("""WITH x AS (SELECT o_orderkey AS event_id FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 23 = 0), n AS (SELECT event_id, count(*) AS m FROM x GROUP BY event_id),
    p AS (SELECT o_orderstatus AS ns, count(*) AS n, min(o_orderdate) > max(o_orderdate) AS bad FROM orders GROUP BY 1)
    SELECT 'ledger' AS source, CASE WHEN m > 1 THEN 'duplicate' WHEN event_id % 17 = 0 THEN 'digest_differs' ELSE 'ok' END AS status, sum(m)::BIGINT AS n FROM n GROUP BY 1, 2
    UNION ALL SELECT 'population', CASE WHEN ns = 'P' THEN 'count_differs' ELSE 'ok' END, count(*) FROM p GROUP BY 1, 2""")
def src_registry(spark, d):
    ledger, population = files.scratch(spark, "ledger"), files.scratch(spark, "population")
    o = table(spark, d, "orders")
    payload = F.col("o_custkey").cast("string")
    rows = o.select(F.col("o_orderkey").alias("event_id"), payload.alias("payload"), F.when(F.col("o_orderkey") % 17 == 0, "0").otherwise(F.sha2(payload, 256)).alias("sha256"))
    rows.unionByName(rows.where("event_id % 23 = 0")).write.json(ledger)
    # a declaration is a row for each id, and its head; P names some ids twice
    o.select(F.col("o_orderstatus").alias("ns"), F.col("o_orderkey").alias("event_id")).unionByName(o.where("o_orderstatus = 'P'").select(F.col("o_orderstatus").alias("ns"), F.col("o_orderkey").alias("event_id")).where("event_id % 3 = 0")).write.json(population)
    heads = o.groupBy(F.col("o_orderstatus").alias("ns")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("started_at"), F.max("o_orderdate").alias("stopped_at"))
    a = files.checked_ledger(spark.read.schema("event_id long, payload string, sha256 string").json(ledger))
    b = files.checked_declaration(spark.read.schema("ns string, event_id long").json(population), heads)
    count = lambda df, s: df.groupBy(F.lit(s).alias("source"), "status").agg(F.count("*").alias("n"))
    return count(a, "ledger").unionByName(count(b, "population"))


_NODE = "'e-' || substr(sha256({0} || chr(0) || CAST({1} AS VARCHAR)), 1, 24)"
_WIKI = {"revision": "rev", "wiki": "wiki", "page": "page", "label": "label", "prefix": "ip16", "body": "body_sha"}


def _wiki_nodes(spark, d):
    path = files.scratch(spark, "revisions")
    bound(spark, d, "revs").select(*_WIKI.values()).write.json(path)
    revs = spark.read.schema("rev long, wiki string, page string, label string, ip16 string, body_sha string").json(path)
    return _union(files.nodes(revs, kind, key) for kind, key in _WIKI.items())


_WIKI_SQL = " UNION ALL ".join(f"SELECT DISTINCT {_NODE.format(repr(kind), key)} AS entity_id, '{kind}' AS subkind, CAST({key} AS VARCHAR) AS key FROM revs WHERE {key} IS NOT NULL" for kind, key in _WIKI.items())


@query(with_sql("revs") + _WIKI_SQL.join((" ", "")))
def src_wiki(spark, d):
    return _wiki_nodes(spark, d)


@query(with_sql("revs") + f", e AS ({_WIKI_SQL}) SELECT CASE WHEN subkind IN ('revision', 'body') THEN 'ingest' ELSE 'derive' END AS stage, subkind, count(*) AS n, count(DISTINCT entity_id) AS ids FROM e GROUP BY 1, 2")
def graph_roundtrip(spark, d):
    path, x = files.scratch(spark, "graph"), _wiki_nodes(spark, d)
    raw = F.col("subkind").isin("revision", "body")
    files.save_stage(x.where(raw), path, "ingest")
    files.save_stage(x.where(~raw), path, "derive")
    e = files.load_graph(spark, path, "entity_id string, subkind string, key string")
    once = e.groupBy("stage", "subkind", "entity_id").agg(F.count("*").alias("m"))
    return once.groupBy("stage", "subkind").agg(F.sum("m").alias("n"), F.count("*").alias("ids"))


_SESSION, _MESSAGE = _NODE.format("'session'", "conv_id"), _NODE.format("'message'", "conv_id || '/' || turn")


@query(f"SELECT DISTINCT {_MESSAGE} AS subject, 'member_of' AS kind, {_SESSION} AS object FROM conversations UNION ALL SELECT DISTINCT {_SESSION}, 'sent', {_MESSAGE} FROM conversations WHERE role = 'assistant'")
def src_transcripts(spark, d):
    path = files.scratch(spark, "transcripts")
    table(spark, d, "conversations").select("conv_id", "turn", "role", "text").write.json(path)
    x = spark.read.schema("conv_id string, turn long, role string, text string").json(path)
    x = x.withColumn("message", F.concat("conv_id", F.lit("/"), F.col("turn").cast("string")))
    session, message = ("session", "conv_id"), ("message", "message")
    return files.edges(x, "member_of", message, session).unionByName(files.edges(x.where("role = 'assistant'"), "sent", session, message))


@query("SELECT doc_id, count(*) AS times, count(*) > 1 AS repeated FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0) GROUP BY doc_id")
def src_labels(spark, d):
    path, x = files.scratch(spark, "labels"), table(spark, d, "labels")
    x.unionByName(x.where("doc_id % 10 = 0")).write.json(path)
    read = spark.read.schema("doc_id long, quality int, toxic int").json(path)
    return read.groupBy("doc_id").agg(F.count("*").alias("times")).withColumn("repeated", F.col("times") > 1)


@query(with_sql("claims") + " SELECT cid, 't0' AS clock, t0 AS seen_at FROM claims WHERE t0 IS NOT NULL UNION ALL SELECT cid, 't1', t1 FROM claims WHERE t1 IS NOT NULL")
def time_claims(spark, d):
    return bound(spark, d, "claims").select("cid", "t0", "t1").unpivot("cid", ["t0", "t1"], "clock", "seen_at").where("seen_at is not null")


# The graph: attributes are JSON texts, and one row in four was only seen as a reference.


def _graph(spark, d):
    attrs = F.to_json(F.struct("event_type", F.col("user_id").alias("transcript"), F.when(F.col("event_id") % 4 == 0, "true").alias("observed_as_reference")))
    return table(spark, d, "events").select(files.entity_id(F.col("event_type"), F.col("event_id")).alias("entity_id"), F.col("event_type").alias("subkind"), F.col("event_id").alias("key"), F.col("ts").alias("time_lower"), attrs.alias("attrs"))


_GRAPH = f"""WITH g AS (SELECT {_NODE.format('event_type', 'event_id')} AS entity_id, event_type AS subkind, event_id AS key, ts AS time_lower,
    '{{"event_type":"' || event_type || '","transcript":' || user_id || CASE WHEN event_id % 4 = 0 THEN ',"observed_as_reference":"true"' ELSE '' END || '}}' AS attrs FROM events) """


@query(_GRAPH + "SELECT entity_id, subkind, key, CAST(json_extract(attrs, '$.transcript') AS BIGINT) AS transcript FROM g WHERE coalesce(json_extract_string(attrs, '$.observed_as_reference'), 'false') <> 'true'")
def native_entities(spark, d):
    seen = F.coalesce(files.json_fragment(F.col("attrs"), "$.observed_as_reference", "string"), F.lit("false"))
    return _graph(spark, d).where(seen != "true").select("entity_id", "subkind", "key", files.json_fragment(F.col("attrs"), "$.transcript", "long").alias("transcript"))


@query(_GRAPH + """SELECT entity_id, subkind, key, row_number() OVER (ORDER BY time_lower NULLS LAST, key) AS place FROM g WHERE subkind = 'click' AND attrs ILIKE '%"TRANSCRIPT":1%' ORDER BY place LIMIT 200""")
def entity_browse(spark, d):
    hit = _graph(spark, d).where(F.col("subkind") == "click").where(F.col("attrs").ilike('%"TRANSCRIPT":1%'))
    page = hit.orderBy(F.asc_nulls_last("time_lower"), "key").limit(200)
    return page.select("entity_id", "subkind", "key", F.row_number().over(Window.orderBy(F.asc_nulls_last("time_lower"), "key")).alias("place"))


@query(_GRAPH + "SELECT subkind, count(*) AS n, count(DISTINCT key) AS keys, count(time_lower) AS timed, count(*) FILTER (attrs LIKE '%observed_as_reference%') AS referenced FROM g GROUP BY subkind")
def witness_profile(spark, d):
    referenced = F.count_if(F.col("attrs").contains("observed_as_reference"))
    return _graph(spark, d).groupBy("subkind").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.count("time_lower").alias("timed"), referenced.alias("referenced"))


@query(_GRAPH + ", w AS (SELECT *, row_number() OVER (PARTITION BY subkind ORDER BY key) AS r FROM g) SELECT subkind, list_sort(list(entity_id)) AS cited, min(key) AS first FROM w WHERE r <= 6 GROUP BY subkind")
def citation_lookup(spark, d):
    w = _graph(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("subkind").orderBy("key"))).where("r <= 6")
    return w.groupBy("subkind").agg(F.array_sort(F.collect_list("entity_id")).alias("cited"), F.min("key").alias("first"))


@query(_GRAPH + "SELECT subkind, count(*) AS n, count(DISTINCT json_extract(attrs, '$.transcript')) AS transcripts FROM g GROUP BY subkind")
def adhoc_sql(spark, d):
    return spark.sql("SELECT subkind, count(*) AS n, count(DISTINCT try_variant_get(try_parse_json(attrs), '$.transcript', 'bigint')) AS transcripts FROM {g} GROUP BY subkind", g=_graph(spark, d))


# Declarations: trust, scenarios, staleness.


@query("""WITH x AS (SELECT DISTINCT l_orderkey AS event_id, l_suppkey % 5 AS domain FROM lineitem),
    p AS (SELECT a.event_id, CASE WHEN (a.domain + b.domain) % 4 = 0 THEN 'same' WHEN (a.domain + b.domain) % 4 < 3 THEN 'independent' END AS relation FROM x a JOIN x b ON a.event_id = b.event_id AND a.domain < b.domain)
    SELECT x.event_id, CASE WHEN count(DISTINCT domain) = 1 THEN 'same' WHEN coalesce(any_value(i), false) THEN 'independent' WHEN coalesce(any_value(s), false) THEN 'same' ELSE 'unknown' END AS trust
    FROM x LEFT JOIN (SELECT event_id, bool_and(coalesce(relation, '') = 'independent') AS i, bool_and(coalesce(relation, '') = 'same') AS s FROM p GROUP BY event_id) q ON q.event_id = x.event_id GROUP BY x.event_id""")
def trust_relation(spark, d):
    """Domains of a record are a set of at most five, so its pairs are taken within the row."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 5)).alias("domains"))
    sums = F.flatten(F.transform("domains", lambda a: F.transform(F.filter("domains", lambda b: b > a), lambda b: (a + b) % 4)))
    trust = F.when(F.size("domains") == 1, "same").when(F.forall(sums, lambda s: (s > 0) & (s < 3)), "independent").when(F.forall(sums, lambda s: s == 0), "same").otherwise("unknown")
    return x.select("event_id", trust.alias("trust"))


_SCENARIOS = {  # authentic, exclusive, indep of a claim under each set of declarations
    "declared": ("authentic", "exclusive", "indep"),
    "all_exclusive": ("authentic", "true", "indep"),
    "possession_only": ("false", "false", "indep"),
    "one_domain": ("authentic", "exclusive", "false"),
}
_SCENARIO_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS scenario, * FROM ({C._ladder_sql().replace('token, authentic, exclusive, indep FROM claims', f'token, {a} AS authentic, {e} AS exclusive, {i} AS indep FROM claims')} SELECT outcome, method, count(*) AS n FROM answers GROUP BY outcome, method)"
    for name, (a, e, i) in _SCENARIOS.items()
)


@query(_SCENARIO_SQL)
def scenarios(spark, d):
    """Records and claims are joined once; each pair is then judged under every set of declarations."""
    sets = F.array(*(F.struct(F.lit(n).alias("scenario"), *(F.expr(x).alias(c) for c, x in zip(("authentic", "exclusive", "indep"), flags, strict=True))) for n, flags in _SCENARIOS.items()))

    def vary(pair):
        x = pair.withColumn("s", F.explode(sets)).drop("authentic", "exclusive", "indep")
        return x.select("*", "s.*").drop("s")

    x = R.reconcile(bound(spark, d, "ledger"), bound(spark, d, "claims"), vary=vary, per=("scenario",))
    return x.groupBy("scenario", "outcome", "method").agg(F.count("*").alias("n"))


@query(with_sql("ledger") + """, h AS (SELECT ns, event_id, CAST('0x' || substr(sha256(CAST(event_id AS VARCHAR) || '|' || coalesce(token_sha, '')), 1, 12) AS BIGINT) AS h FROM ledger)
    SELECT ns, count(*) AS n, CAST(sum(h) AS VARCHAR) AS fingerprint, coalesce(bool_or(ns = 'P' AND event_id % 10 = 0 AND h > 0), false) AS stale FROM h GROUP BY ns""")
def stale_results(spark, d):
    """Results are stale where the evidence's fingerprint is no more the one they were computed from; that of P
    lacked every tenth record.  A sum of row digests is the same in any order and is built from partial sums."""
    h = F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), F.coalesce("token_sha", F.lit(""))), 256)
    x = bound(spark, d, "ledger").withColumn("h", F.conv(F.substring(h, 1, 12), 16, 10).cast("decimal(20,0)"))
    then = F.sum(F.when((F.col("ns") != "P") | (F.col("event_id") % 10 != 0), F.col("h")))
    y = x.groupBy("ns").agg(F.count("*").alias("n"), F.sum("h").alias("now"), then.alias("then"))
    return y.select("ns", "n", F.col("now").cast("string").alias("fingerprint"), (~F.col("now").eqNullSafe(F.col("then"))).alias("stale"))


@query(with_sql("claims") + " SELECT event_id, list_sort(list(DISTINCT 'w-' || (transcript % 10))) AS witnesses, count(*) AS n FROM claims GROUP BY event_id")
def reconcile_edges(spark, d):
    """Witnesses are ten, so a record's set is small however many claims it has."""
    w = F.concat(F.lit("w-"), (F.col("transcript") % 10).cast("string"))
    return bound(spark, d, "claims").groupBy("event_id").agg(F.array_sort(F.collect_set(w)).alias("witnesses"), F.count("*").alias("n"))


# Joins and estimates.


@query(with_sql("revs") + """, s AS (SELECT rev AS save, CASE WHEN rev % 4 = 0 THEN rev + 1 ELSE rev END AS ref, page FROM revs)
    SELECT save, count(r.rev) AS n, CASE WHEN count(r.rev) = 1 THEN 'supported' WHEN count(r.rev) > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome FROM s LEFT JOIN revs r ON r.rev = s.ref AND r.page = s.page GROUP BY save""")
def wiki_saves(spark, d):
    r = bound(spark, d, "revs").select("rev", "page")
    s = r.select(F.col("rev").alias("save"), F.when(F.col("rev") % 4 == 0, F.col("rev") + 1).otherwise(F.col("rev")).alias("ref"), F.col("page").alias("at"))
    n = s.join(r, (F.col("ref") == F.col("rev")) & (F.col("at") == F.col("page")), "left").groupBy("save").agg(F.count("rev").alias("n"))
    return n.withColumn("outcome", F.when(F.col("n") == 1, "supported").when(F.col("n") > 1, "ambiguous").otherwise("unmatched"))


@query("SELECT page_id, r AS rev FROM (SELECT page_id, unnest([page_id, 2 * page_id]) AS r FROM pages) JOIN documents ON doc_id = r")
def lineage_located_on(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.array("page_id", 2 * F.col("page_id"))).alias("rev"))
    return links.join(table(spark, d, "documents").select(F.col("doc_id").alias("rev")), "rev").select("page_id", "rev")


@query(with_sql("revs") + """, b AS (SELECT a.rev FROM revs a JOIN revs p ON a.diff_base = p.rev AND a.page = p.page WHERE a.rev % 2 = 0), c AS (SELECT DISTINCT label FROM revs WHERE trim(label) <> '' AND rev IN (SELECT rev FROM b))
    SELECT count(*) AS n_population, count(DISTINCT nullif(trim(label), '')) AS n_sampled, (SELECT count(*) FROM c) AS covered FROM revs""")
def coverage_units(spark, d):
    revs = based_revisions(spark, d, "label", "page")
    hit = L.built_on(revs).where("rev % 2 = 0").select("rev", F.lit(True).alias("hit"))
    unit = F.when(F.trim("label") != "", F.col("label"))
    by = revs.join(hit, "rev", "left").groupBy(unit.alias("unit")).agg(F.count("*").alias("m"), F.bool_or(F.coalesce("hit", F.lit(False))).alias("hit"))
    return by.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n_population"), F.count("unit").alias("n_sampled"), F.count_if(F.col("unit").isNotNull() & F.col("hit")).alias("covered"))


@query(with_sql("revs") + " SELECT wiki, count(*) AS n, count(*) FILTER (label = 'web') AS handled, CAST(count(*) FILTER (label = 'web') AS DOUBLE) / count(*) AS share FROM revs GROUP BY wiki")
def authorship(spark, d):
    own = F.count_if(F.col("label") == "web")
    return bound(spark, d, "revs").groupBy("wiki").agg(F.count("*").alias("n"), own.alias("handled"), (own.cast("double") / F.count("*")).alias("share"))


@query(with_sql("revs") + """, p AS (SELECT a.rev, b.rev AS parent FROM revs a JOIN revs b ON a.diff_base = b.rev AND a.page = b.page), t AS (SELECT rev, CASE WHEN rev % 10 = 0 THEN -1 ELSE diff_base END AS parent FROM revs WHERE diff_base IS NOT NULL)
    SELECT count(*) FILTER (p.rev IS NOT NULL AND t.rev IS NOT NULL) AS tp, count(*) FILTER (t.rev IS NULL) AS fp, count(*) FILTER (p.rev IS NULL) AS fn FROM p FULL OUTER JOIN t ON p.rev = t.rev AND p.parent = t.parent""")
def score_sets(spark, d):
    revs = based_revisions(spark, d, "page")
    p = L.built_on(revs).withColumn("p", F.lit(True))
    t = revs.where("diff_base is not null").select("rev", F.when(F.col("rev") % 10 == 0, -1).otherwise(F.col("diff_base")).alias("parent"), F.lit(True).alias("t"))
    both = p.join(t, ["rev", "parent"], "full_outer")
    return both.agg(F.count_if(F.col("p") & F.col("t")).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


@query(with_sql("claims", "ledger") + """, x AS (SELECT c.event_id, bool_or(token = 'forged') AS forged, any_value(l.event_id) IS NOT NULL AS held FROM claims c LEFT JOIN ledger l ON l.event_id = c.event_id GROUP BY c.event_id)
    SELECT count(*) FILTER (forged) AS fabricated, count(*) FILTER (forged AND NOT held) AS contradicted, count(*) FILTER (forged AND held) AS missed, count(*) FILTER (NOT held AND NOT coalesce(forged, false)) AS false_positives FROM x""")
def score_fabrication(spark, d):
    c = bound(spark, d, "claims").groupBy("event_id").agg(F.coalesce(F.bool_or(F.col("token") == "forged"), F.lit(False)).alias("forged"))
    x = c.join(bound(spark, d, "ledger").select("event_id", F.lit(True).alias("held")), "event_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    n = lambda c: F.count_if(c)
    return x.agg(n(F.col("forged")).alias("fabricated"), n(F.col("forged") & ~F.col("held")).alias("contradicted"), n(F.col("forged") & F.col("held")).alias("missed"), n(~F.col("held") & ~F.col("forged")).alias("false_positives"))


def _interval_sql(sums: str, statistic: str, estimate: str = "estimate") -> str:
    stats = f"WITH sums AS ({sums}), s AS (SELECT key, draw, {statistic} AS s FROM sums)"
    return f"{stats} SELECT key, round(max(s) FILTER (draw = 0), 9) AS {estimate}, round(quantile_cont(s, 0.025) FILTER (draw > 0), 9) AS lower, round(quantile_cont(s, 0.975) FILTER (draw > 0), 9) AS upper FROM s GROUP BY key"


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ROUNDED = ("estimate", "mean", "lower", "upper")


def _rounded(x):
    return x.withColumns({c: F.round(c, 9) for c in _ROUNDED if c in x.columns})


@query(_interval_sql(resample.draws_sql("lineitem", "l_returnflag", _LINE, {"total": "CAST(l_quantity AS DOUBLE)", "known": "CAST(l_quantity IS NOT NULL AS INT)"}, 100), "total / nullif(known, 0)", "mean").replace("SELECT key, round", "SELECT key AS l_returnflag, round"))
def bootstrap_mean(spark, d):
    return _rounded(E.bootstrap_mean(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", id=_LINE))


@query(_interval_sql(resample.draws_sql("lineitem", "l_returnflag", _LINE, {"a": "CAST(l_discount AS DOUBLE) * CAST(l_quantity AS DOUBLE)", "b": "CAST(l_quantity AS DOUBLE)"}, 200, 3), "a / nullif(b, 0)"))
def bootstrap_ratio(spark, d):
    """A ratio of two sums by a statistic of the caller's, here discounts weighted by quantity."""
    q = F.col("l_quantity").cast("double")
    x = resample.bootstrap(table(spark, d, "lineitem"), "l_returnflag", {"a": F.col("l_discount").cast("double") * q, "b": q}, resample.ratio("a", "b"), _LINE, 200, 3)
    return _rounded(x.withColumnRenamed("l_returnflag", "key"))


@query(_interval_sql(resample.draws_sql("documents", "lang", ["doc_id"], {"long": "CAST(n_chars >= 400 AS INT)"}, 200), "long / n"))
def bootstrap_share(spark, d):
    """The share of long documents by language."""
    x = resample.bootstrap(table(spark, d, "documents"), "lang", {"long": (F.col("n_chars") >= 400).cast("int")}, lambda s: s["long"] / s["n"], ["doc_id"], 200)
    return _rounded(x.withColumnRenamed("lang", "key"))


@query()
def capture_intervals(spark, d):
    """How many commitments two listings of the ledger point to, by namespace: the chance of each listing is a hash of the id."""
    seen = lambda salt: F.pmod(F.xxhash64("event_id", F.lit(salt)), F.lit(10)) < 4
    n = bound(spark, d, "ledger").groupBy("ns").agg(F.count_if(seen(1)).alias("a"), F.count_if(seen(2)).alias("b"), F.count_if(seen(1) & seen(2)).alias("m"), F.count("*").alias("truth"))
    return resample.capture_interval(n)


_FACTS = {
    "documents": {"rows": "count(*)", "with_text": "count(text)", "langs": "count(DISTINCT lang)", "chars": "CAST(sum(n_chars) AS BIGINT)", "shortest": "min(n_chars)", "longest": "max(n_chars)"},
    "pages": {"rows": "count(*)", "urls": "count(DISTINCT url)", "first_id": "min(page_id)", "last_id": "max(page_id)"},
    "labels": {"rows": "count(*)", "good": "CAST(sum(quality) AS BIGINT)", "toxic": "CAST(sum(toxic) AS BIGINT)"},
    "events": {"rows": "count(*)", "users": "count(DISTINCT user_id)", "types": "count(DISTINCT event_type)"},
}


@query(" UNION ALL ".join(f"SELECT '{t}' AS source, '{n}' AS name, {e} AS value FROM {t}" for t, facts in _FACTS.items() for n, e in facts.items()))
def facts_measure(spark, d):
    """One scan and one aggregate for each table, turned into rows."""
    one = lambda t, facts: table(spark, d, t).agg(*(F.expr(e).cast("long").alias(n) for n, e in facts.items()))
    return _union(one(t, facts).unpivot([], list(facts), "name", "value").select(F.lit(t).alias("source"), "name", "value") for t, facts in _FACTS.items())


@query("""WITH e AS (SELECT user_id AS transcript, max(ts) AS final_ts FROM events WHERE event_type <> 'signup' GROUP BY user_id), r AS (SELECT user_id AS transcript, min(ts) AS refresh FROM events WHERE event_type = 'signup' GROUP BY user_id),
    x AS (SELECT transcript, CAST(epoch_us(refresh) - epoch_us(final_ts) AS DOUBLE) / 1000000 AS delta FROM e JOIN r USING (transcript))
    SELECT transcript, delta, CASE WHEN delta > 86400 THEN 'supported' WHEN delta < -86400 THEN 'contradicted' ELSE 'ambiguous' END AS outcome FROM x""")
def ordering_vs_bound(spark, d):
    signup, us = F.col("event_type") == "signup", lambda c: F.unix_micros(c.cast("timestamp"))
    x = table(spark, d, "events").groupBy(F.col("user_id").alias("transcript")).agg(F.max(F.when(~signup, F.col("ts"))).alias("final"), F.min(F.when(signup, F.col("ts"))).alias("refresh")).where("final is not null and refresh is not null")
    delta = (us(F.col("refresh")) - us(F.col("final"))) / F.lit(1e6)
    return x.select("transcript", delta.alias("delta"), F.when(delta > 86400, "supported").when(delta < -86400, "contradicted").otherwise("ambiguous").alias("outcome"))


# Triage.

_OPTIONS = ["claims_completed_write", "reports_failed_write", "no_write_claim", "quotes_other_claim"]


def _answers(spark, d):
    """Answers about documents: every ninth breaks a rule."""
    x, n = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n")), F.col("doc_id") % 9
    p = (F.col("n") % 81) / F.lit(100.0) + 0.2
    rest = (1 - p) / 3
    probabilities = F.when(n == 8, None).otherwise(F.map_from_arrays(F.array(*(F.lit(o) for o in _OPTIONS[:3]), F.when(n == 7, "other").otherwise(_OPTIONS[3])), F.array(rest, rest, F.when(n == 6, p + 1).when(n == 5, p - 0.2).otherwise(p), rest)))
    return x.select("doc_id", probabilities.alias("probabilities"), F.when(n == 4, "claims_completed_write").when(n == 3, "other").otherwise("no_write_claim").alias("label"), p.alias("p"))


_ANSWERS = """WITH x AS (SELECT doc_id, doc_id % 9 AS n, (coalesce(n_chars, 0) % 81) / 100.0::DOUBLE + 0.2 AS p FROM documents),
    s AS (SELECT *, CASE n WHEN 8 THEN 'unavailable' WHEN 7 THEN 'options_differ' WHEN 6 THEN 'not_a_probability' WHEN 5 THEN 'sum_differs' WHEN 4 THEN CASE WHEN (1 - p) / 3 + 1e-9 < greatest(p, (1 - p) / 3) THEN 'choice_not_highest' ELSE 'answered' END
      WHEN 3 THEN 'choice_not_offered' ELSE CASE WHEN p + 1e-9 < greatest(p, (1 - p) / 3) THEN 'choice_not_highest' ELSE 'answered' END END AS status FROM x) """


@query(_ANSWERS + "SELECT doc_id, status FROM s")
def answer_status(spark, d):
    return _answers(spark, d).select("doc_id", triage.answer_status(F.col("probabilities"), _OPTIONS, F.col("label")).alias("status"))


@query(_ANSWERS + """SELECT doc_id, CASE WHEN status <> 'answered' THEN 'unscored' WHEN n = 4 THEN 'review' WHEN p < 0.8 OR 3 * ((1 - p) / 3) > 0.1 THEN 'uncertain' ELSE 'background' END AS disposition,
    status = 'answered' AND n = 4 AND (1 - p) / 3 >= 0.05 AS relayed FROM s""")
def disposition(spark, d):
    status = triage.answer_status(F.col("probabilities"), _OPTIONS, F.col("label"))
    queue, relayed = triage.write_disposition(status, F.col("label"), F.col("probabilities"), F.col("p"))
    return _answers(spark, d).select("doc_id", queue.alias("disposition"), relayed.alias("relayed"))


@query(_ANSWERS + """, q AS (SELECT doc_id, CASE WHEN status <> 'answered' THEN 'unscored' WHEN n = 4 THEN 'review' WHEN p < 0.8 OR 3 * ((1 - p) / 3) > 0.1 THEN 'uncertain' ELSE 'background' END AS recomputed FROM s)
    SELECT doc_id, 'stale' AS stored, recomputed FROM q WHERE doc_id % 97 = 0""")
def recheck(spark, d):
    """Stored dispositions that recomputing does not give, or gives and nothing stored."""
    path, now = files.scratch(spark, "dispositions"), disposition(spark, d).select("doc_id", F.col("disposition").alias("recomputed"))
    now.select("doc_id", F.when(F.col("doc_id") % 97 == 0, "stale").otherwise(F.col("recomputed")).alias("stored")).write.parquet(path)
    return spark.read.parquet(path).join(now, "doc_id", "full_outer").where(~F.col("stored").eqNullSafe(F.col("recomputed"))).select("doc_id", "stored", "recomputed")


# Streams.


@query("SELECT event_id, ts, event_type FROM events")
def stream_ingest(spark, d):
    rows = live.follow(spark, f"{d}/events.parquet").select("event_id", "ts", "event_type")
    out = live.drain(live.ingest(rows, "event_id", "ts"), files.scratch(spark, "ingest"), files.scratch(spark, "state"))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(with_sql("tools", "execs") + """ SELECT tool, exec, CASE WHEN t.cmd <> e.cmd THEN 'unmatched' WHEN t.output IS NULL OR e.output IS NULL THEN 'not_assessable' WHEN t.output = e.output THEN 'supported' ELSE 'contradicted' END AS outcome
    FROM tools t JOIN execs e ON t.transcript = e.transcript AND e.t >= t.t0 - interval '12 hours' AND e.t <= t.t1 + interval '12 hours'""")
def stream_corroborate(spark, d):
    events = f"{d}/events.parquet"
    part = lambda name: bound(spark, d, name, live.follow(spark, events))
    return live.drain(live.corroborate(part("tools"), part("execs")), files.scratch(spark, "pairs"), files.scratch(spark, "state"))


@query(with_sql("ledger", "claims") + """, x AS (SELECT c.event_id, CASE WHEN token_sha IS NULL THEN 'unavailable' WHEN token IS NULL THEN 'unbound' WHEN sha256(token) = token_sha THEN 'bound' ELSE 'mismatch' END AS bind FROM claims c JOIN ledger l ON l.event_id = c.event_id)
    SELECT event_id, count(*) AS n, count(*) FILTER (bind = 'bound') AS tied FROM x GROUP BY event_id""")
def stream_claims(spark, d):
    claims = bound(spark, d, "claims", live.follow(spark, f"{d}/lineitem.parquet"))
    out = live.drain(live.candidates(claims, bound(spark, d, "ledger")), files.scratch(spark, "candidates"), files.scratch(spark, "state"))
    return out.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("bind") == "bound").alias("tied"))


# Reports: one row for each question.

_RANK = {"supported": 5, "ambiguous": 4, "contradicted": 3, "unmatched": 2, "not_assessable": 1}


def _question(id: str, outcomes: DataFrame) -> DataFrame:
    """The strongest outcome of a question's rows, or not_assessable where it has none, and their number."""
    rank = F.element_at(F.create_map(*(F.lit(v) for kv in _RANK.items() for v in kv)), F.col("outcome"))
    by = outcomes.groupBy("outcome").agg(F.count("*").alias("m"))
    return by.agg(F.lit(id).alias("question_id"), F.coalesce(F.max_by("outcome", rank), F.lit("not_assessable")).alias("outcome"), F.coalesce(F.sum("m"), F.lit(0)).alias("n"))


def _question_sql(id: str, rows: str) -> str:
    order = " ".join(f"WHEN '{o}' THEN {r}" for o, r in _RANK.items())
    return f"SELECT '{id}' AS question_id, coalesce(arg_max(outcome, CASE outcome {order} END), 'not_assessable') AS outcome, count(*) AS n FROM ({rows})"


def _docket_parts():
    said = "select outcome from ({})"
    some = "SELECT CASE WHEN {} THEN 'supported' ELSE 'ambiguous' END AS outcome FROM ({}) q"
    own = C.ORACLE_SQL
    pick = lambda name, cond: some.format(cond, own[name])
    return {
        "DQ1": ("activity", "n > 0", pick("activity", "n > 0")),
        "DQ2": ("authorship", "handled > 0", pick("authorship", "handled > 0")),
        "DQ3": ("families", "pages > 0", pick("families", "pages > 0")),
        "DQ4": ("fact_audit", "status = 'exact'", pick("fact_audit", "status = 'exact'")),
        "DQ5": ("identity_labels", "false", pick("identity_labels", "false")),
        "DQ6": ("lineage_built_on", "true", pick("lineage_built_on", "true")),
        "DQ7": ("retention", "retention >= 0.5", pick("retention", "retention >= 0.5")),
        "DQ8": ("limits", "false", pick("limits", "false")),
        "LQ1": ("lq1_attribution", None, said.format(own["lq1_attribution"])),
        "LQ2": ("lq2_launches", None, said.format(own["lq2_launches"])),
        "LQ3": ("lq3_named_outputs", "true", pick("lq3_named_outputs", "true")),
        "LQ4": ("version_history", None, said.format(own["version_history"])),
        "LQ5": ("lq5_absent_claims", None, said.format(own["lq5_absent_claims"])),
        "LQ6": ("coverage_records", "k > 0", pick("coverage_records", "k > 0")),
        "LQ7": ("ordering_vs_bound", None, said.format(own["ordering_vs_bound"])),
        "LQ8": ("exposure", None, f"SELECT CASE outcome WHEN 'denied' THEN 'contradicted' ELSE outcome END AS outcome FROM ({own['exposure']})"),
    }


_DOCKET = _docket_parts()


@query(" UNION ALL ".join(_question_sql(id, sql) for id, (_, _, sql) in _DOCKET.items()))
def docket(spark, d):
    """One row for each question; what several of them ask of the ladder is answered once."""
    answers = files.through(C._answers(spark, d, told=("transcript",)), "answers")

    def part(id, name, cond):
        given = {"answers": answers} if name in ("lq1_attribution", "version_history", "coverage_records") else {}
        x = C.QUERIES[name](spark, d, **given)
        outcome = F.when(F.expr(cond), "supported").otherwise("ambiguous") if cond else F.when(F.col("outcome") == "denied", "contradicted").otherwise(F.col("outcome"))
        return _question(id, x.select(outcome.alias("outcome")))

    return _union(part(id, name, cond) for id, (name, cond, _) in _DOCKET.items())
