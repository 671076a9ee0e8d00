"""The ladder under twelve conditions of evidence and declarations, held against what each must give, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators import reconcile as R
from factweave.plans.bindings import table
from factweave.plans.catalogue import query

# Every order has a receipt of its making; every seventh has no record, so its receipt is invented.  Witness A keeps the
# orders divisible by 4; of those, the ones divisible by 8 have copies of the receipt with another witness: one of its
# public part (no token) and one of the whole.
RECORDS = "SELECT o_orderkey AS event_id, o_orderstatus AS ns, sha2(concat('tok-', CAST(o_orderkey AS STRING)), 256) AS token_sha, o_orderdate AS ts, false AS idem FROM {orders} WHERE o_orderkey % 7 <> 0"
CLAIMS = """SELECT concat(kind, '-', CAST(o_orderkey AS STRING)) AS cid, o_orderkey AS event_id, o_orderstatus AS ns, o_orderdate AS t0, o_orderdate + interval '1' day AS t1,
    CASE WHEN kind <> 'public' THEN concat('tok-', CAST(o_orderkey AS STRING)) END AS token, false AS authentic, true AS exclusive, true AS indep
    FROM (SELECT o_orderkey, o_orderstatus, o_orderdate, explode(CASE WHEN o_orderkey % 7 = 0 THEN array('invented') WHEN o_orderkey % 8 = 0 THEN array('true', 'public', 'relay') ELSE array('true') END) AS kind FROM {orders})"""

# (condition, kinds of receipts there, A's own receipts there, tokens kept, tokens exclusive, clocks related, witnesses
# independent, population complete, receipts inside the captured window, records that must be supported, invented ones contradicted)
CONDITIONS = [
    ("clean", "true", True, True, True, True, True, True, True, "all", False),
    ("fabricated", "true invented", True, True, True, True, True, True, True, "all", True),
    ("missing_transcript", "true invented", False, True, True, True, True, True, True, "others", True),
    ("copied_public_receipt", "true public", False, True, True, True, True, True, True, "others", False),
    ("full_receipt_relay", "true relay", False, True, False, True, True, True, True, "none", False),
    ("false_exclusivity", "true relay", False, True, True, True, True, True, True, "relayed", False),
    ("shared_tokens_no_attack", "true", True, True, False, True, True, True, True, "none", False),
    ("missing_tokens", "true", True, False, True, True, True, True, True, "none", False),
    ("missing_clock_bound", "true", True, True, True, False, True, True, True, "none", False),
    ("dependent_witnesses", "true invented", True, True, True, True, False, True, True, "none", False),
    ("incomplete_capture", "true invented", True, True, True, True, True, False, True, "all", False),
    ("capture_window_edge", "true invented", True, True, True, True, True, True, False, "all", False),
]
NAMES = ("condition", "kinds", "own", "tokens", "excl", "clock", "apart", "complete", "inside", "want", "refute")


def _all():
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(NAMES, row, strict=True))) for row in CONDITIONS))


def _present(kind, event):
    """Whether a receipt of that kind is there under the condition c."""
    return F.contains(F.col("c.kinds"), kind) & (F.col("c.own") | (kind != "true") | (event % 4 != 0))


def _decided(spark, d, exclusive: bool = False) -> DataFrame:
    """(event_id, condition, outcome, cid) of every record under every condition; exclusive: all tokens are taken as exclusive."""

    def vary(pair: DataFrame) -> DataFrame:
        x = pair.withColumn("c", F.explode(_all()))
        there = _present(F.split_part("cid", F.lit("-"), F.lit(1)), F.col("event_id"))
        return x.withColumns({
            "cid": F.when(there, F.col("cid")), "digest": F.when(F.col("c.tokens"), F.col("digest")), "exclusive": F.col("c.excl") | F.lit(exclusive),
            "indep": F.when(there, F.col("c.apart")), "clock": F.col("c.clock"), "condition": F.col("c.condition"),
        })

    orders = table(spark, d, "orders")
    return R.reconcile(spark.sql(RECORDS, orders=orders), spark.sql(CLAIMS, orders=orders), "1 day", vary=vary, per=("condition",))


def _scored(decided: DataFrame) -> DataFrame:
    """(condition, supported, correct, errors, want, want_errors) by condition."""
    yes, event = F.col("outcome") == "supported", F.col("event_id")
    right = yes & (F.col("cid") == F.concat(F.lit("true-"), event.cast("string")))
    wants = lambda *w: F.col("condition").isin([row[0] for row in CONDITIONS if row[9] in w])
    relayed = wants("relayed") & (event % 8 == 0)
    want = wants("all") | (wants("others", "relayed") & (event % 4 != 0)) | relayed
    n = lambda x: F.count_if(x)
    return decided.groupBy("condition").agg(n(yes).alias("supported"), n(right).alias("correct"), n(yes & ~right).alias("errors"), n(want).alias("want"), n(relayed).alias("want_errors"))


def _receipts(spark, d) -> DataFrame:
    """(condition, accepted, captured, contradicted, want_contradicted): the receipts there, the false ones among them, and
    of those without a record the ones that the population's declaration refutes."""
    orders = table(spark, d, "orders")
    claims, records = spark.sql(CLAIMS, orders=orders), spark.sql(RECORDS, orders=orders)
    window = orders.groupBy(F.col("o_orderstatus").alias("ns")).agg((F.min("o_orderdate") - F.expr("interval 10 days")).alias("started_at"), (F.max("o_orderdate") + F.expr("interval 10 days")).alias("stopped_at"), F.lit(True).alias("complete"))
    absent = R.absent_claims(claims, records, window, "1 day").where("outcome = 'contradicted'").select("cid", F.lit(True).alias("refuted"))
    x = claims.select("cid", "event_id", F.split_part("cid", F.lit("-"), F.lit(1)).alias("kind")).join(absent, "cid", "left").withColumn("c", F.explode(_all()))
    x = x.where(_present(F.col("kind"), F.col("event_id")))
    false, invented = F.col("kind") != "true", F.col("kind") == "invented"
    bad = F.coalesce("refuted", F.lit(False)) & F.col("c.complete") & F.col("c.inside") & F.col("c.apart")
    return x.groupBy(F.col("c.condition").alias("condition")).agg(F.count("*").alias("accepted"), F.count_if(false).alias("captured"), F.count_if(bad).alias("contradicted"), F.count_if(invented & F.col("c.refute")).alias("want_contradicted"))


_VALUES = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).lower() for v in row) + ")" for row in CONDITIONS)
_SQL = f"""WITH c({', '.join(NAMES)}) AS (VALUES {_VALUES}), k(kind) AS (VALUES ('true'), ('public'), ('relay'), ('invented')),
    r AS (SELECT o_orderkey AS e, kind FROM orders, k WHERE CASE WHEN o_orderkey % 7 = 0 THEN kind = 'invented' WHEN o_orderkey % 8 = 0 THEN kind <> 'invented' ELSE kind = 'true' END),
    there AS (SELECT * FROM r, c WHERE contains(kinds, kind) AND (own OR kind <> 'true' OR e % 4 <> 0)),
    per AS (SELECT e, condition, count(*) AS n, any_value(kind) AS kind FROM there WHERE kind <> 'invented' GROUP BY ALL),
    decided AS (SELECT o_orderkey AS e, c.*, kind, coalesce(n = 1 AND tokens AND kind <> 'public' AND clock AND apart, false) AS possible FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) CROSS JOIN c LEFT JOIN per ON e = o_orderkey AND per.condition = c.condition),
    receipts AS (SELECT condition, count(*) AS accepted, count(*) FILTER (kind <> 'true') AS captured, count(*) FILTER (kind = 'invented' AND complete AND inside AND apart) AS contradicted, count(*) FILTER (kind = 'invented' AND refute) AS want_contradicted FROM there GROUP BY condition)"""


@query(_SQL + """, s AS (SELECT condition, count(*) FILTER (possible AND excl) AS supported, count(*) FILTER (possible AND excl AND kind = 'true') AS correct, count(*) FILTER (possible AND excl AND kind <> 'true') AS errors FROM decided GROUP BY condition)
    SELECT condition, supported, correct, errors, captured, contradicted, true AS passed FROM s JOIN receipts USING (condition)""")
def scenario_report(spark, d):
    """Supported, correct and wrong answers and refuted receipts of each condition, and whether they are as they must be."""
    x = _scored(_decided(spark, d)).join(_receipts(spark, d), "condition")
    passed = (F.col("supported") == F.col("want")) & (F.col("errors") == F.col("want_errors")) & (F.col("contradicted") == F.col("want_contradicted"))
    return x.select("condition", "supported", "correct", "errors", "captured", "contradicted", passed.alias("passed"))


@query(_SQL + """, s AS (SELECT condition, count(*) FILTER (possible) AS supported, count(*) FILTER (possible AND kind = 'true') AS correct, count(*) FILTER (possible AND kind <> 'true') AS errors FROM decided GROUP BY condition)
    SELECT condition, supported, correct, errors, accepted, captured AS false_accepts FROM s JOIN receipts USING (condition)""")
def ablation_legacy(spark, d):
    """The same with every token taken as exclusive, and a control that accepts every receipt."""
    x = _scored(_decided(spark, d, exclusive=True)).join(_receipts(spark, d), "condition")
    return x.select("condition", "supported", "correct", "errors", "accepted", F.col("captured").alias("false_accepts"))
