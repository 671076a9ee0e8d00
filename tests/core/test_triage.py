"""Labels and dispositions, case by case."""

from pyspark.sql import functions as F

from factweave.operators import triage

CASES = [
    ("user", None, None, "no_write_claim"),
    ("user", "", True, "plans_write"),
    ("user", "[truncated] saved it", True, "insufficient_context"),
    ("user", "good morning", False, "no_write_claim"),
    ("assistant", "Ann told me the page was saved", False, "quotes_other_claim"),
    ("assistant", "the upload was REJECTED", False, "reports_failed_write"),
    ("assistant", "I haven't saved it", False, "denies_write"),
    ("assistant", "I'll upload it", False, "plans_write"),
    ("assistant", "Uploaded", False, "claims_completed_write"),
    ("tool", '{"accepted": true}', True, "claims_completed_write"),
    ("tool", '{"accepted": false}', True, "insufficient_context"),
    ("tool", "no json", True, "insufficient_context"),
    ("tool", "error", True, "reports_failed_write"),
    ("tool", "error", False, "no_write_claim"),
    (None, "saved", False, "claims_completed_write"),
]


def test_write_claim(spark):
    df = spark.createDataFrame(CASES, "role string, text string, calls boolean, want string")
    got = df.select("*", triage.write_claim(F.col("role"), F.col("text"), F.col("calls")).alias("got"))
    assert [r for r in got.collect() if r.want != r.got] == []


def test_search_disposition(spark):
    df = spark.createDataFrame([(None, 0.1, "unscored"), (1.5, 0.1, "review"), (0.5, 0.4, "uncertain"), (0.5, 0.5, "background"), (0.4, 0.1, "background")], "score double, conf double, want string")
    got = df.select("want", triage.search_disposition(F.col("score"), F.col("conf")).alias("got"))
    assert all(r.want == r.got for r in got.collect())
