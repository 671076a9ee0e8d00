"""Coverage, capture-recapture and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.operators.resample import bootstrap, ratio


def record_coverage(edges: DataFrame, key: str) -> DataFrame:
    """n assessable, k supported, the rest excluded, and k / n for each key."""
    n = F.count_if(F.col("outcome") != "not_assessable")
    k = F.count_if(F.col("outcome") == "supported")
    return edges.groupBy(key).agg(n.alias("n"), k.alias("k"), (F.count("*") - n).alias("excluded"), F.try_divide(k.cast("double"), n.cast("double")).alias("estimate"))


def proportion_interval(counts: DataFrame, key: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """The central 95 % of seeded binomial draws for each key's k of n; null where n is 0."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n, k = int(pdf.n.iloc[0]), int(pdf.k.iloc[0])
        lo, hi = np.quantile(np.random.default_rng(seed).binomial(n, k / n, draws) / n, [0.025, 0.975]) if n else (None, None)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [n], "k": [k], "lower": [lo], "upper": [hi]})

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, "n", "k").groupBy(key).applyInPandas(one, f"{key} {kind}, n long, k long, lower double, upper double")


def chapman(counts: DataFrame) -> DataFrame:
    """a, b, m and the Chapman estimate, null without overlap."""
    raw = (F.col("a") + 1) * (F.col("b") + 1) / (F.col("m") + 1) - 1
    return counts.select("a", "b", "m", F.when(F.col("m") > 0, F.bround(raw, 3)).alias("estimate"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "pred").agg(F.count("*").alias("n"))


def class_scores(rows: DataFrame) -> DataFrame:
    """Precision, recall and support of every class among labels and predictions."""
    both = rows.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("pred")).cast("int").alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("x")).select("x.*")
    t, p, h = F.sum("t"), F.sum("p"), F.sum("h")
    return both.groupBy("label").agg(F.try_divide(h.cast("double"), p.cast("double")).alias("precision"), F.try_divide(h.cast("double"), t.cast("double")).alias("recall"), t.alias("support"))


def bootstrap_mean(rows: DataFrame, value: str, key: str, draws: int = 100, seed: int = 0, id: list[str] | None = None) -> DataFrame:
    """(key, mean, lower, upper): the mean of a column and the central 95 % of its means over resamples; null values take
    no part (see resample.bootstrap).  Without id a row's weights depend on how rows are dealt out."""
    if id is None:
        rows, id = rows.withColumn("_row", F.monotonically_increasing_id()), ["_row"]
    measures = {"total": F.col(value), "known": F.col(value).isNotNull().cast("int")}
    return bootstrap(rows, key, measures, ratio("total", "known"), id, draws, seed).withColumnRenamed("estimate", "mean")
