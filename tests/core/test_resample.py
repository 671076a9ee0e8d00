"""Bootstrap of any statistic against plain resampling with the same weights; capture-recapture intervals."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.operators import resample as R


def test_same_for_any_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = [("ab?"[i % 3] if i % 3 < 2 else None, i, float(rng.integers(0, 100)), float(rng.integers(1, 9))) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double")
    measures = {"x": F.col("x"), "y": F.col("y")}
    ask = lambda d: {r.g: (r.estimate, r.lower, r.upper) for r in R.bootstrap(d, "g", measures, R.ratio("x", "y"), ["id"], 150, 5).collect()}
    got = ask(df.coalesce(1))
    assert got == ask(df.repartition(7)) and set(got) == {"a", "b", None}
    ups, cuts = R.steps(150, 5), R.thresholds()
    for g in got:
        mine = [r for r in rows if r[0] == g]
        start = [int(hashlib.sha256(str(r[1]).encode()).hexdigest()[:12], 16) % (R.PRIME - 1) + 1 for r in mine]
        w = [[sum(s * u % R.PRIME >= c for c in cuts) for s in start] for u in ups]
        stats = [sum(k * r[2] for k, r in zip(d, mine, strict=True)) / sum(k * r[3] for k, r in zip(d, mine, strict=True)) for d in w]
        assert np.allclose(got[g], (sum(r[2] for r in mine) / sum(r[3] for r in mine), *np.quantile(stats, [0.025, 0.975])))


def test_weights_are_poisson():
    start = np.random.default_rng(0).integers(1, R.PRIME, 20_000)
    w = np.searchsorted(R.thresholds(), start[:, None] * np.array(R.steps(30, 0)) % R.PRIME, "right")
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and np.abs(np.corrcoef(w.T) - np.eye(30)).max() < 0.05
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005


def test_covers_what_it_should(spark):
    """Intervals of a mean are about as wide as its standard error asks for; a statistic without value is passed over."""
    df = spark.range(4000).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 2 == 0, (F.col("id") % 100).cast("double")).alias("v"))
    got = {r.g: r for r in R.bootstrap(df, "g", {"v": F.col("v"), "n_v": F.col("v").isNotNull().cast("int")}, R.ratio("v", "n_v"), ["id"], 400).collect()}
    assert got[1].estimate is None and got[1].lower is None
    spread = np.std(np.arange(0, 100, 2)) / 2000**0.5
    assert got[0].estimate == 49.0 and 3.3 < (got[0].upper - got[0].lower) / spread < 4.6
    with pytest.raises(ValueError):
        R.bootstrap(df, "g", {}, lambda s: s["n"], ["id"], 10)
    assert R.bootstrap(df.limit(0), "g", {"v": F.col("v")}, R.ratio("v", "n"), ["id"], 100).collect() == []


def test_capture_interval(spark):
    rows = [(50, 40, 20), (10, 20, 0), (1, 2, 3), (50, 50, 50), (None, 2, 1), (3 * 10**9, 2 * 10**9, 10**9)]
    df = spark.createDataFrame(rows, "a long, b long, m long")
    got = {r.a: r for r in R.capture_interval(df, seed=9).collect()}
    x = next(r for r in R.capture_interval(df, seed=9).collect() if (r.a, r.m) == (50, 20))
    overlap = np.random.default_rng(9).hypergeometric(50, round(x.estimate) - 50, 40, size=2000)
    assert abs(x.estimate - 100) < 5 and x.lower <= 100 <= x.upper and (x.lower, x.upper) == tuple(np.quantile(51 * 41 / (overlap + 1) - 1, [0.025, 0.975]))
    assert got[10].estimate is None and got[10].lower is None and got[10].violations == ["Zero overlap: no finite population estimate reported"]
    assert got[1].violations == got[None].violations == ["Counts that can't be"]
    big = got[3 * 10**9]
    assert abs(big.estimate / 6e9 - 1) < 1e-6 and big.lower < 6e9 < big.upper
    named = R.capture_interval(df.where("m = 20"), violations=["same source"]).first()
    assert named.violations == ["same source"] and named.lower is not None
