"""Scans over chunks against pandas over whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketlake.functions import scan, windows
from marketlake.operators import indicators as ind
from marketlake.operators import regime
from tests.test_operators import BARS, day


def frame(spark, values, ticker="A", days=None):
    days = days if days is not None else range(len(values))
    return [(ticker, day(int(d)), None if np.isnan(v) else float(v)) for d, v in zip(days, values, strict=True)]


@pytest.mark.parametrize("days", [1, 7, 64, 512])
@pytest.mark.parametrize("adjusted", [False, True])
def test_weighted_means_follow_pandas(spark, days, adjusted):
    """Missing values at the start, inside, and over whole chunks; days without a row."""
    rng = np.random.default_rng(days)
    rows, want = [], {}
    for n, t in enumerate("ABCD"):
        x = rng.standard_normal(150) + 5
        x[rng.random(150) < [0, 0.3, 0.9, 1.0][n]] = np.nan
        x[: 5 * n] = np.nan
        at = np.sort(rng.choice(400, 150, replace=False))
        rows += frame(spark, x, t, at)
        want |= {(t, day(int(d))): v for d, v in zip(at, pd.Series(x).ewm(alpha=0.2, adjust=adjusted, min_periods=3).mean(), strict=True)}
    df = spark.createDataFrame(rows, "ticker string, date date, x double").repartition(3)
    got = scan.weighted(df, "date", ("ticker",), {"m": scan.Weighted("r.x", 0.2, adjusted, 3)}, days).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["ticker"], r["date"]]
        assert (r["m"] is None and np.isnan(w)) or abs(r["m"] - w) < 1e-9, r


def test_change_over_the_edge_of_chunks(spark):
    x = np.arange(50.0) ** 2
    df = spark.createDataFrame(frame(spark, x), "ticker string, date date, x double")
    got = scan.weighted(df, "date", ("ticker",), {"m": scan.Weighted("r.x - p.x", 0.5)}, 8).orderBy("date").toPandas()["m"].astype(float)
    np.testing.assert_allclose(got, pd.Series(x).diff().ewm(alpha=0.5, adjust=False).mean())
    with pytest.raises(ValueError):
        scan.weighted(df, "date", ("ticker",), {"m": scan.Weighted("r.x", 0.9)}, 512)


@pytest.mark.parametrize("days", [1, 10, 512])
def test_fill_forward_and_numbers(spark, days):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(200)
    x[rng.random(200) < 0.8] = np.nan
    x[:15] = x[60:100] = np.nan
    at = np.sort(rng.choice(1000, 200, replace=False))
    df = spark.createDataFrame(frame(spark, x, "A", at) + frame(spark, x[:50], None, at[:50]), "ticker string, date date, x double").repartition(4)
    got = scan.numbered(scan.fill_forward(df, ["x"], ["date"], ("ticker",), days), "date", ("ticker",), "n", days).where("ticker = 'A'").orderBy("date").toPandas()
    np.testing.assert_allclose(got["x"].astype(float), pd.Series(x).ffill())
    assert got["n"].tolist() == list(range(200))
    assert scan.fill_forward(df, ["x"], ["date"], ("ticker",), days).count() == 200  # rows without a key go


@pytest.mark.parametrize("block", [20, 64, 2048])
def test_rolling_frames_in_blocks(spark, block):
    x = np.random.default_rng(2).standard_normal(300)
    df = spark.createDataFrame(frame(spark, x), "ticker string, date date, x double")
    got = scan.in_blocks(df, "date", 20, lambda r, w: r.withColumn("m", windows.sma(F.col("x"), 20, w)), block=block).orderBy("date").toPandas()
    np.testing.assert_allclose(got["m"].astype(float), pd.Series(x).rolling(20).mean())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_window_over_everything(spark):
    dates = spark.range(600).select(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 7).cast("double").alias("close"))
    aligned = regime.align(dates.withColumnRenamed("close", "vix"), regime.slope(dates))
    of = regime.as_of(dates.select("date"), regime.classify(aligned))
    for df in (aligned, of):
        for line in plan_of(df).splitlines():
            assert "Window [" not in line or "_chunk" in line or "_block" in line, line


def test_one_ticker_of_five_million_bars(spark):
    """No Python, and no more in a task than some chunks: the values at the end are those of a plain loop over the last bars."""
    n = 5_000_000
    x = F.pmod(F.col("id") * 7919, F.lit(1000)) / 10
    rows = spark.range(0, n, 1, 8).select(F.lit("A").alias("ticker"), F.date_from_unix_date(F.col("id").cast("int")).alias("date"), x.alias("close"))
    out = scan.weighted(rows, "date", ("ticker",), {"m": scan.Weighted("r.close", 2 / 13), "c": scan.Weighted("abs(r.close - p.close)", 1 / 14, True, 14)}, 2048)
    plan = plan_of(out) + plan_of(ind.exponential(spark.createDataFrame([], BARS)))
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    got = out.agg(F.count("*").alias("n"), F.max_by(F.struct("m", "c"), "date").alias("last")).first()
    c = pd.Series([(i * 7919) % 1000 / 10 for i in range(n - 4000, n)])
    want = [c.ewm(span=12, adjust=False).mean().iloc[-1], c.diff().abs().ewm(com=13).mean().iloc[-1]]
    assert got["n"] == n
    np.testing.assert_allclose(list(got["last"]), want, rtol=1e-9)
