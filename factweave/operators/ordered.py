"""Exact order within groups of any size: ranks, previous values and running sums without a group in one task.

Rows are dealt by ranges of (group, order), sorted within each and written; a row's place in its range is then known
without a window.  A range's share of a group is a slice: slices are counted, their counts are summed over the group's
earlier slices (at most one for each range, however many rows they hold), and a row's rank is its place within the slice
plus what came before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factweave.sources.files import through

PLACES = (1 << 33) - 1  # what monotonically_increasing_id() numbers within a partition


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], into: str = "rank", previous: dict[str, str] | None = None, running: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with the rank (from 1) of each row in its group, by order.

    previous: new column -> column whose value it has in the row before (null in a group's first).  running: new column ->
    column whose sum over the rows up to this one it holds (null counts as 0).  order has to tell a group's rows apart,
    else the rank of equal ones is any; rows of equal group and order are one range, so it is also what bounds a range.  A
    null group is one group; without columns in group all rows are one.  parts: ranges, by default as many as shuffles have.
    """
    spark, previous, running = df.sparkSession, previous or {}, running or {}
    keys = [*(F.col(g).asc() for g in group), *order]
    dealt = df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    rows = through(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit(PLACES))}), "ordered")
    sums = {f"_sum_{new}": F.sum(F.coalesce(c, F.lit(0))) for new, c in running.items()}
    lasts = {f"_last_{new}": F.max_by(c, "_at") for new, c in previous.items()}
    slices = rows.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *(x.alias(n) for n, x in {**sums, **lasts}.items()))
    slices = slices.toDF("_in", *(f"_group_{g}" for g in group), *slices.columns[1 + len(group) :])
    earlier = Window.partitionBy(*(f"_group_{g}" for g in group)).orderBy("_in")
    before = lambda c: F.coalesce(F.sum(c).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = slices.withColumns({"_before": before("_n"), **{n: before(n) for n in sums}, **{n: F.lag(n).over(earlier) for n in lasts}})
    on = F.col("_range") == F.col("_in")
    for g in group:
        on &= F.col(g).eqNullSafe(F.col(f"_group_{g}"))
    out = rows.join(slices, on).withColumn(into, F.col("_at") - F.col("_first") + 1 + F.col("_before"))
    within = Window.partitionBy("_range", "_first").orderBy("_at")
    for new, c in previous.items():
        out = out.withColumn(new, F.when(F.col("_at") == F.col("_first"), F.col(f"_last_{new}")).otherwise(F.lag(c).over(within)))
    for new, c in running.items():
        out = out.withColumn(new, F.sum(F.coalesce(c, F.lit(0))).over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col(f"_sum_{new}"))
    return out.select(*df.columns, into, *previous, *running)


def ranking_scores(rows: DataFrame, group: str, hit: str, order: Sequence[Column | str], at: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """For each group: ranked rows, relevant ones (hit is 1), average precision (null without any), the reciprocal rank of
    the first (0 without any), and precision and recall among the first k."""
    r = ranked(rows.select(group, hit, *(c for c in rows.columns if c not in (group, hit))), [group], order, running={"hits": hit})
    one = F.col(hit) == 1
    top = lambda k: F.count_if(one & (F.col("rank") <= k)).cast("double")
    relevant = F.count_if(one)
    precision = F.sum(F.when(one, F.col("hits") / F.col("rank")).otherwise(0.0))
    first = F.min(F.when(one, F.col("rank")))
    return r.groupBy(group).agg(
        F.count("*").alias("ranked"), relevant.alias("relevant"), F.round(F.try_divide(precision, relevant.cast("double")), 9).alias("average_precision"), F.coalesce(1.0 / first, F.lit(0.0)).alias("reciprocal_rank"),
        *(x for k in at for x in ((top(k) / float(k)).alias(f"p_at_{k}"), F.round(F.try_divide(top(k), relevant.cast("double")), 9).alias(f"r_at_{k}"))),
    )
