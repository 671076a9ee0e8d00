"""Evidence tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.operators.ordered import ranked

SQL = {
    "ledger": """SELECT o_orderkey AS event_id, o_orderstatus AS ns, o_orderpriority AS name, sha2(CAST(o_custkey AS STRING),256) AS sha,
        CASE WHEN o_orderkey%5=0 THEN NULL ELSE sha2(concat('tok-',CAST(o_orderkey AS STRING)),256) END AS token_sha,
        o_orderdate AS ts, o_orderkey%11=0 AS idem FROM orders WHERE o_orderkey%7<>0""",
    "claims": """SELECT sha2(concat_ws('|',CAST(l_orderkey AS STRING),CAST(l_linenumber AS STRING),CAST(l_partkey AS STRING),
        CAST(l_suppkey AS STRING),CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS STRING),CAST(CAST(l_shipdate AS DATE) AS STRING)),256) AS cid,
        l_orderkey AS event_id, l_suppkey AS transcript, l_shipdate AS t0, l_shipdate + CAST(l_quantity AS INT)*interval '1' day AS t1,
        CASE WHEN l_linenumber%3=0 THEN NULL WHEN l_linenumber%3=1 OR l_linestatus='O' THEN concat('tok-',CAST(l_orderkey AS STRING)) ELSE 'forged' END AS token,
        l_returnflag='A' AS authentic, l_returnflag='R' AS exclusive, l_suppkey%10<>0 AS indep,
        CASE l_orderkey%3 WHEN 0 THEN 'O' WHEN 1 THEN 'F' ELSE 'P' END AS ns FROM lineitem""",
    "population": """SELECT o_orderstatus AS ns, count(*) AS n, o_orderstatus<>'P' AS complete, min(o_orderdate) AS started_at, max(o_orderdate) AS stopped_at
        FROM orders WHERE o_orderkey%7<>0 GROUP BY o_orderstatus""",
    "revs": """SELECT doc_id AS rev, lang AS wiki, source AS label, concat(source,'~',CAST(doc_id%40 AS STRING)) AS page, sha2(text,256) AS body_sha,
        n_chars AS body_len, doc_id AS t, CASE doc_id%3 WHEN 0 THEN 'reqlog' WHEN 1 THEN 'rclog' ELSE 'write_date' END AS grade,
        lag(doc_id) OVER (PARTITION BY source, doc_id%40 ORDER BY doc_id) AS diff_base, concat('10.',CAST(doc_id%17 AS STRING)) AS ip16 FROM documents""",
    "tools": """SELECT event_id AS tool, user_id AS transcript, ts AS t0, ts + interval '1' hour AS t1, concat('cmd',CAST(event_id%5 AS STRING)) AS cmd,
        CASE WHEN event_id%8=0 THEN NULL ELSE CAST(floor(value) AS BIGINT)%3 END AS output FROM events WHERE event_type='click'""",
    "execs": """SELECT event_id AS exec, user_id AS transcript, ts AS t, concat('cmd',CAST(event_id%5 AS STRING)) AS cmd,
        CASE WHEN event_id%8=0 THEN NULL ELSE CAST(floor(value) AS BIGINT)%3 END AS output FROM events WHERE event_type='view'""",
    "refreshes": "SELECT event_id AS refresh, ts, event_type AS route, sha2(props,256) AS digest FROM events WHERE event_type='signup' AND event_id%10<3",
    "reads": "SELECT event_id AS read_id, ts, CASE WHEN event_id%9=0 THEN 403 ELSE 200 END AS status, sha2(props,256) AS digest FROM events WHERE event_type='purchase'",
    "ranges": "SELECT p_partkey AS range_id, p_brand AS list, p_partkey%2048*2097152 AS lo, p_partkey%2048*2097152 + p_size*65536 AS hi FROM part",
}
_BASE = "\n        lag(doc_id) OVER (PARTITION BY source, doc_id%40 ORDER BY doc_id) AS diff_base,"  # in Spark: based_revisions()
_FROM = {"ledger": "orders", "claims": "lineitem", "population": "orders", "revs": "documents", "tools": "events", "execs": "events", "refreshes": "events", "reads": "events", "ranges": "part"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str, rows: DataFrame | None = None) -> DataFrame:
    """The evidence table of that name, over rows (a stream, say) instead of the source table if given."""
    source = _FROM[name]
    if name == "revs":
        return spark.sql(SQL[name].replace(_BASE, "").replace("FROM documents", "FROM {source}"), source=table(spark, sf_dir, source) if rows is None else rows)
    return spark.sql(SQL[name].replace(f"FROM {source}", "FROM {source}"), source=table(spark, sf_dir, source) if rows is None else rows)


def by_event(spark: SparkSession, sf_dir: str, name: str, text: bool = False) -> DataFrame:
    """The ledger or the claims, dealt by their events' ids: what moves is the source's rows, and what derives from them,
    digests of 64 signs among it, is made where a join on event_id then takes place (text: on the id as text, with as many parts as shuffles have)."""
    key = {"ledger": "o_orderkey", "claims": "l_orderkey"}[name]
    rows = table(spark, sf_dir, _FROM[name])
    return bound(spark, sf_dir, name, rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(key).cast("string")) if text else rows.repartition(key))


def based_revisions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """rev, the columns and diff_base of the revisions: the revision before on the same page, which may hold any share of them."""
    revs = bound(spark, sf_dir, "revs").select("rev", *columns, F.col("label").alias("of"), (F.col("rev") % 40).alias("place"))
    return ranked(revs, ["of", "place"], ["rev"], previous={"diff_base": "rev"}).drop("of", "place", "rank")


def with_sql(*names: str) -> str:
    """The same tables as common table expressions of the oracle's dialect."""
    text = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return "WITH " + text.replace(",256)", ")").replace("sha2(", "sha256(").replace("STRING", "VARCHAR")
