"""Ranks, previous values and running sums against plain sorting, with groups that span many ranges."""

import random

from pyspark.sql import functions as F

from factweave.operators.ordered import ranked, ranking_scores
from factweave.plans import catalogue


def test_against_sorting(spark):
    rng = random.Random(0)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.randrange(50), i, rng.choice([None, 0, 1, 2]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, id int, w int, rank_of string").repartition(5)
    out = ranked(df, ["g"], [F.desc("v"), F.col("id")], previous={"before": "id", "w_before": "w"}, running={"total": "w"}, parts=16)
    assert out.columns == ["g", "v", "id", "w", "rank_of", "rank", "before", "w_before", "total"]
    got = {r.id: (r.rank, r.before, r.w_before, r.total) for r in out.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        before, total = None, 0
        for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            total += r[3] or 0
            want[r[2]] = (k, before and before[2], before and before[3], total) if before else (k, None, None, total)
            before = r
    assert got == want


def test_without_groups_and_rows(spark):
    df = spark.range(500).repartition(3)
    assert all(r.rank == 500 - r.id for r in ranked(df, [], [F.desc("id")], parts=7).collect())
    assert ranked(df.where("id < 0"), [], ["id"]).collect() == []


def test_scores(spark):
    rows = [("q", s, i, int(i in (1, 3, 40))) for i, s in enumerate(range(100, 0, -1))] + [("none", 1, 0, 0)]
    df = spark.createDataFrame(rows, "source string, s int, id int, hit int")
    got = {r.source: r for r in ranking_scores(df, "source", "hit", [F.desc("s"), F.col("id")]).collect()}
    q = got["q"]
    assert (q.ranked, q.relevant, q.p_at_3, q.r_at_3, q.p_at_10, q.reciprocal_rank) == (100, 3, 1 / 3, round(1 / 3, 9), 0.2, 0.5)
    assert q.average_precision == round((1 / 2 + 2 / 4 + 3 / 41) / 3, 9)
    assert (got["none"].relevant, got["none"].average_precision, got["none"].reciprocal_rank, got["none"].r_at_5) == (0, None, 0.0, None)


def test_no_window_over_a_group(spark, capsys):
    for name, group in (("eval_ranking", "source"), ("version_history", "name"), ("lineage_built_on", "label")):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
        windows = [x for x in capsys.readouterr().out.splitlines() if "windowspecdefinition" in x]
        assert windows and all(f"({group}#" not in w for w in windows)
