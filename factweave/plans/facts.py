"""Published facts of a corpus recomputed from its tables: some sixty of them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factweave.operators.facts import Fact, audit, histogram, measure
from factweave.plans.bindings import table
from factweave.plans.catalogue import query
from factweave.sources import files

FACTS = [
    Fact("documents", "documents", "count(*)"), Fact("documents.with_text", "documents", "count(text)"), Fact("documents.empty", "documents", "count_if(length(text) = 0)"), Fact("documents.ids", "documents", "count(DISTINCT doc_id)"),
    Fact("documents.sources", "documents", "count(DISTINCT source)"), Fact("documents.langs", "documents", "count(DISTINCT lang)"), Fact("documents.chars", "documents", "sum(n_chars)"), Fact("documents.shortest", "documents", "min(n_chars)"),
    Fact("documents.longest", "documents", "max(n_chars)"), Fact("documents.short", "documents", "count_if(n_chars < 100)"), Fact("documents.long", "documents", "count_if(n_chars >= 10000)"), Fact("documents.first", "documents", "min(doc_id)"),
    Fact("documents.last", "documents", "max(doc_id)"), *histogram("documents", "lang", ("en", "fr", "de", "es")),
    Fact("pages", "pages", "count(*)"), Fact("pages.ids", "pages", "count(DISTINCT page_id)"), Fact("pages.urls", "pages", "count(DISTINCT url)"), Fact("pages.https", "pages", "count_if(url LIKE 'https:%')"), Fact("pages.html_chars", "pages", "sum(length(html))"),
    Fact("pages.longest", "pages", "max(length(html))"), Fact("pages.empty", "pages", "count_if(html IS NULL OR length(html) = 0)"), Fact("pages.first", "pages", "min(page_id)"), Fact("pages.last", "pages", "max(page_id)"),
    Fact("events", "events", "count(*)"), Fact("events.users", "events", "count(DISTINCT user_id)"), Fact("events.types", "events", "count(DISTINCT event_type)"), Fact("events.with_props", "events", "count(props)"), Fact("events.first", "events", "min(event_id)"),
    Fact("events.last", "events", "max(event_id)"), Fact("events.costly", "events", "count_if(value >= 100)"), Fact("events.days", "events", "count(DISTINCT CAST(ts AS DATE))"), *histogram("events", "event_type", ("click", "view", "purchase", "signup", "error")),
    Fact("labels", "labels", "count(*)"), Fact("labels.documents", "labels", "count(DISTINCT doc_id)"), Fact("labels.good", "labels", "sum(quality)"), Fact("labels.toxic", "labels", "sum(toxic)"), Fact("labels.both", "labels", "count_if(quality = 1 AND toxic = 1)"),
    Fact("conversations", "conversations", "count(DISTINCT conv_id)"), Fact("conversations.turns", "conversations", "count(*)"), Fact("conversations.longest", "conversations", "max(turn) + 1"), Fact("conversations.chars", "conversations", "sum(length(text))"),
    *histogram("conversations", "role", ("system", "user", "assistant")),
    Fact("ledger", "orders", "count(*)"), Fact("ledger.customers", "orders", "count(DISTINCT o_custkey)"), Fact("ledger.first", "orders", "min(o_orderkey)"), Fact("ledger.last", "orders", "max(o_orderkey)"), *histogram("orders", "o_orderstatus", ("O", "F", "P")),
    Fact("claims", "lineitem", "count(*)"), Fact("claims.records", "lineitem", "count(DISTINCT l_orderkey)"), Fact("claims.transcripts", "lineitem", "count(DISTINCT l_suppkey)"), *histogram("lineitem", "l_returnflag", ("A", "N", "R")),
]
#: Facts of a manifest that rest on what a case doesn't hold.
EXCLUDED = {"requests.total": "the request log is not part of the export", "events.types": "published by another counting rule"}
TABLES = sorted({f.table for f in FACTS})
_MEASURED = " UNION ALL ".join(f.sql() for f in FACTS)


def _measured(spark, d):
    return measure({t: table(spark, d, t) for t in TABLES}, FACTS)


@query(_MEASURED)
def facts_compiled(spark, d):
    """All declared facts, from one scan of each table."""
    return _measured(spark, d)


@query(f"""WITH m AS ({_MEASURED}), p AS (SELECT name, CASE WHEN name LIKE '%.longest' THEN value + 1 ELSE value END AS published FROM m UNION ALL SELECT 'requests.total', 7 UNION ALL SELECT 'documents.unheard_of', 7)
    SELECT p.name, published, CASE WHEN p.name = 'events.types' THEN NULL ELSE m.value END AS measured,
      CASE WHEN p.name IN ('requests.total', 'events.types') OR m.value IS NULL THEN 'not_computable' WHEN published = m.value THEN 'exact' ELSE 'differs' END AS status,
      CASE p.name WHEN 'requests.total' THEN 'the request log is not part of the export' WHEN 'events.types' THEN 'published by another counting rule' ELSE CASE WHEN m.value IS NULL THEN 'no computation declared' END END AS reason
    FROM p LEFT JOIN m ON m.name = p.name""")
def facts_audited(spark, d):
    """A manifest, written and read as JSON, against what the tables hold: its longest texts are one too long, one fact
    is excluded, one needs another source and one nobody declared."""
    path, own = files.scratch(spark, "manifest"), _measured(spark, d)
    told = own.withColumn("value", F.when(F.col("name").endswith(".longest"), F.col("value") + 1).otherwise(F.col("value")))
    told.unionByName(spark.createDataFrame([("requests.total", 7), ("documents.unheard_of", 7)], "name string, value long")).write.json(path)
    return audit(spark.read.schema("name string, value long").json(path), own, EXCLUDED)
