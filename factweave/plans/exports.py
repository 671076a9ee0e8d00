"""Queries over exports read through adapters: a wiki's files and a registry's, with what was rejected; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.plans.bindings import table
from factweave.plans.catalogue import query
from factweave.sources import adapters, files, wiki


def _latin(text):
    """A text's bytes as characters of one byte each, as the export writes bodies."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _wiki(spark, d):
    """Documents as revisions (every 17th with another digest, every 23rd twice, a broken line for every 31st), web pages as
    pages with families, and texts of the benchmark as records with one or two origins."""
    path, k = files.scratch(spark, "wiki"), F.col("doc_id")
    docs = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    body = F.struct(
        k.alias("rev_id"), F.col("lang").alias("wiki"), F.concat(F.coalesce("source", F.lit("")), F.lit("~"), (k % 40).cast("string")).alias("page_key"), F.coalesce("source", F.lit("")).alias("label"), F.when(k % 5 != 0, F.concat(F.lit("10."), (k % 17).cast("string"))).alias("ip16"),
        _latin("text").alias("body"), F.lit("utf8").alias("body_encoding"), F.when(k % 17 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.sha2("text", 256)).alias("body_sha256"),
        F.when(k % 3 != 0, F.lit("2024-01-01T00:00:00+00:00")).alias("time"), F.when(k % 3 == 1, "reqlog").alias("winning_clock"), F.when(k % 6 == 1, F.lit("2024-01-02T02:00:00+02:00")).alias("write_date"),
    )
    line = F.to_json(body)
    lines = F.array_compact(F.array(line, F.when(k % 23 == 0, line), F.when(k % 31 == 0, F.concat(F.lit('{"rev_id":'), k.cast("string"), F.lit(',"rev_id":1}')))))
    docs.select(F.explode(lines).alias("value")).write.text(f"{path}/revisions.jsonl")
    p = F.col("page_id")
    confidence = F.when(p % 3 == 0, '"high"').when(p % 3 == 1, "0.9").otherwise("0.5")
    table(spark, d, "pages").select(F.concat(F.lit('{"page_key":"p'), p.cast("string"), F.lit('","wiki":"web","page_family":"f'), (p % 7).cast("string"), F.lit('","page_family_confidence":'), confidence, F.lit("}")).alias("value")).write.text(f"{path}/pages.jsonl")
    i = F.col("item_id")
    sites = F.array_compact(F.array(F.struct(F.concat(F.lit("s"), (i % 5).cast("string")).alias("site")), F.when(i % 2 == 0, F.struct(F.lit("all").alias("site")))))
    table(spark, d, "benchmark").select(F.to_json(F.struct(i.alias("id"), "text", sites.alias("origins"))).alias("value")).write.text(f"{path}/records.jsonl")
    adapters.register(spark)
    return spark.read.format("factweave_wiki").option("path", path).load()


_ID = "'e-' || substr(sha256('{0}' || chr(0) || {1}), 1, 24)"
_SQL = """WITH r AS (SELECT doc_id AS k, CAST(doc_id AS VARCHAR) AS key, lang AS wiki, coalesce(source, '') || '~' || doc_id % 40 AS page, coalesce(source, '') AS label, CASE WHEN doc_id % 5 <> 0 THEN '10.' || doc_id % 17 END AS ip16, sha256(coalesce(text, '')) AS body,
      CASE WHEN doc_id % 3 <> 0 THEN true END AS timed FROM documents),
    ok AS (SELECT * FROM r WHERE k % 17 <> 0), p AS (SELECT 'p' || page_id AS key, 'f' || page_id % 7 AS family, page_id % 3 = 2 AS unsure FROM pages), b AS (SELECT CAST(item_id AS VARCHAR) AS key, unnest(CASE WHEN item_id % 2 = 0 THEN ['s' || item_id % 5, 'all'] ELSE ['s' || item_id % 5] END) AS site FROM benchmark) """


@query(_SQL + """, n AS (SELECT 'revision' AS subkind, key, true AS own FROM ok UNION ALL SELECT 'wiki', wiki, false FROM ok WHERE wiki <> '' UNION ALL SELECT 'page', page, false FROM ok UNION ALL SELECT 'label', label, false FROM ok
      UNION ALL SELECT 'network_prefix', ip16, false FROM ok WHERE ip16 IS NOT NULL UNION ALL SELECT 'body', body, false FROM ok UNION ALL SELECT 'page', key, true FROM p UNION ALL SELECT 'wiki', 'web', false FROM p UNION ALL SELECT 'page_family', family, false FROM p
      UNION ALL SELECT 'record', key, true FROM b UNION ALL SELECT 'site', site, false FROM b)
    SELECT 'e-' || substr(sha256(subkind || chr(0) || key), 1, 24) AS entity_id, subkind, key, bool_or(own) AS native FROM n GROUP BY subkind, key""")
def export_nodes(spark, d):
    return wiki.nodes(adapters.accepted(_wiki(spark, d)))


def _edge_sql(of: str, subject: tuple[str, str], kind: str, object: tuple[str, str], method: str, outcome: str, where: str = "true") -> str:
    return f"SELECT {_ID.format(*subject)} AS subject, '{kind}' AS kind, {_ID.format(*object)} AS object, '{method}' AS method, {outcome} AS outcome FROM {of} WHERE {where}"


@query(_SQL + "SELECT DISTINCT * FROM (" + " UNION ALL ".join((
    _edge_sql("ok", ("revision", "key"), "located_on", ("wiki", "wiki"), "source_field", "'supported'", "wiki <> ''"), _edge_sql("ok", ("revision", "key"), "located_on", ("page", "page"), "source_field", "'supported'"),
    _edge_sql("ok", ("label", "label"), "authored", ("revision", "key"), "claimed_label", "'ambiguous'"), _edge_sql("ok", ("network_prefix", "ip16"), "sent", ("revision", "key"), "published_ip16", "'supported'", "ip16 IS NOT NULL"),
    _edge_sql("ok", ("revision", "key"), "member_of", ("body", "body"), "body_sha256", "'supported'"), _edge_sql("p", ("page", "key"), "located_on", ("wiki", "'web'"), "source_field", "'supported'"),
    _edge_sql("p", ("page", "key"), "member_of", ("page_family", "family"), "published_page_family", "CASE WHEN unsure THEN 'ambiguous' ELSE 'supported' END"), _edge_sql("b", ("record", "key"), "located_on", ("site", "site"), "published_origin", "'supported'"),
)) + ")")
def export_edges(spark, d):
    return wiki.edges(adapters.accepted(_wiki(spark, d)))


@query(_SQL + """SELECT key, clock, CAST(seen AS TIMESTAMP) AS seen_at, winning, count(*) AS n FROM (SELECT k, key, CASE WHEN k % 3 = 1 THEN 'reqlog' ELSE 'published_time' END AS clock, '2024-01-01 00:00:00' AS seen, true AS winning FROM ok WHERE timed
      UNION ALL SELECT k, key, 'write_date', '2024-01-02 00:00:00', false FROM ok WHERE k % 6 = 1) CROSS JOIN range(2) AS x(i) WHERE i = 0 OR k % 23 = 0 GROUP BY key, clock, seen, winning""")
def export_times(spark, d):
    """What each clock of a revision says; rows that come twice say it twice."""
    t = wiki.times(adapters.accepted(_wiki(spark, d))).where("tbl = 'revision'")
    return t.groupBy("key", "clock", F.col("at").cast("timestamp_ntz").alias("seen_at"), "winning").agg(F.count("*").alias("n"))


@query(_SQL + """SELECT problem, tbl, n FROM (SELECT 'repeated key' AS problem, NULL AS tbl, count(*) AS n FROM r WHERE k % 31 = 0 UNION ALL SELECT 'body digest differs', NULL, count(*) + count(*) FILTER (k % 23 = 0) FROM r WHERE k % 17 = 0
    UNION ALL SELECT 'repeated key of the table', 'revision', count(*) FROM r WHERE k % 17 <> 0 AND k % 23 = 0) WHERE n > 0""")
def export_rejected(spark, d):
    return adapters.rejected(_wiki(spark, d)).groupBy("problem", "tbl").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT o_orderkey AS k FROM orders), b AS (SELECT DISTINCT k // 64 AS b FROM x)
    SELECT 'registry_mutation' AS tbl, count(*) FILTER (k % 13 <> 0 AND k % 29 <> 0) AS accepted, count(*) FILTER (k % 13 = 0 OR k % 29 = 0) AS rejected, min(k) FILTER (k % 13 <> 0 AND k % 29 <> 0) AS first FROM x
    UNION ALL SELECT 'population', count(*) FILTER (b % 5 <> 0), count(*) FILTER (b % 5 = 0), min(b) FILTER (b % 5 <> 0) FROM b""")
def export_registry(spark, d):
    """Orders as a registry's ledger (every 13th with a digest of other bytes, every 29th with a number no double holds) and
    a population document for each 64 of their ids, of which every fifth counts one too many."""
    path, k = files.scratch(spark, "registry"), F.col("o_orderkey")
    o = table(spark, d, "orders")
    payload = F.col("o_custkey").cast("string")
    line = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"payload":"'), payload, F.lit('","sha256":"'), F.sha2(F.when(k % 13 == 0, "other").otherwise(payload), 256), F.when(k % 29 == 0, F.lit('","x":1e999}')).otherwise(F.lit('"}')))
    o.select(line.alias("value")).write.text(f"{path}/ledger.jsonl")
    each = o.select((k / 64).cast("long").alias("b"), k.alias("k")).groupBy("b").agg(F.collect_list("k").alias("event_ids"))  # 64 at most
    counted = F.struct(F.col("b").cast("string").alias("namespace"), (F.size("event_ids") + F.when(F.col("b") % 5 == 0, 1).otherwise(0)).alias("count"), "event_ids")
    # one document of at most 32 MiB for each part of them
    parts = each.select(F.pmod(F.xxhash64("b"), F.lit(16)).alias("part"), F.floor(F.col("b") / 4096).alias("run"), F.to_json(counted).alias("j")).groupBy("part", "run").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"), F.count("*").alias("n"))
    parts.repartition(F.col("part"), F.col("run")).select("value", F.concat_ws("-", "part", "run").alias("doc")).write.partitionBy("doc").text(f"{path}/population.json")
    adapters.register(spark)
    rows = spark.read.format("factweave_registry").option("path", path).load()
    kind = F.when(F.col("file").contains("population.json"), "population").otherwise("registry_mutation")
    good = F.col("problem").isNull()
    return rows.where("locator <> '#'").groupBy(kind.alias("tbl")).agg(F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"), F.min(F.when(good, F.col("key").cast("long"))).alias("first"))
