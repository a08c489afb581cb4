"""Technical indicators of bars, as columns by date. Rolling ones share the window (ticker, date); exponential ones
are scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.functions import scan
from marketlake.functions import windows as wf
from marketlake.functions.numeric import half_even, present, ratio


def series() -> WindowSpec:
    return wf.series("ticker")


def add_smas(bars: DataFrame, *lengths: int) -> DataFrame:
    return bars.withColumns({f"sma{n}": wf.sma(F.col("close"), n, series()) for n in lengths})


def add_bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower, pct_b, bandwidth; a flat series has no pct_b."""
    mid, dev = wf.sma(F.col("close"), n, series()), wf.rolling_std(F.col("close"), n, series())
    out = bars.withColumns({"bb_mid": mid, "_dev": dev})
    out = out.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_dev"), "bb_lower": F.col("bb_mid") - k * F.col("_dev")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return out.withColumns({"pct_b": ratio(F.col("close") - F.col("bb_lower"), width), "bandwidth": ratio(width, F.col("bb_mid"))}).drop("_dev")


def add_obv(bars: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(wf.diff(F.col("close"), 1, series())), F.lit(0.0)) * F.col("volume")
    return bars.withColumn("_step", step).withColumn("obv", wf.cumsum(F.col("_step"), series())).drop("_step")


def add_roc(bars: DataFrame, n: int = 20) -> DataFrame:
    return bars.withColumn("roc", wf.pct_change(F.col("close"), n, series()))


def add_slope(bars: DataFrame, column: str, n: int = 20, name: str = "slope") -> DataFrame:
    return bars.withColumn(name, wf.pct_change(F.col(column), n, series()))


def add_williams_r(bars: DataFrame, n: int = 14) -> DataFrame:
    """Between -100 and 0; -50 where the window is short or flat."""
    out = bars.withColumns({"_hh": wf.rolling_max(F.col("high"), n, series()), "_ll": wf.rolling_min(F.col("low"), n, series())})
    raw = ratio(F.col("_hh") - F.col("close"), F.col("_hh") - F.col("_ll")) * -100
    return out.withColumn("williams_r", F.coalesce(raw, F.lit(-50.0))).drop("_hh", "_ll")


def add_volume_ratio(bars: DataFrame, n: int = 20) -> DataFrame:
    """Volume over its rolling mean; 1 where that is missing or not positive."""
    out = bars.withColumn("_avg", wf.sma(F.col("volume"), n, series()))
    return out.withColumn("volume_ratio", F.when(F.col("_avg") > 0, F.col("volume") / F.col("_avg")).otherwise(1.0)).drop("_avg")


#: Over a bar r and the one before it p; greatest() passes over what is missing.
TRUE_RANGE = "greatest(r.high - r.low, abs(r.high - p.close), abs(r.low - p.close))"
GAIN = "CASE WHEN r.close - p.close > 0 THEN r.close - p.close WHEN r.close - p.close <= 0 THEN 0D END"
LOSS = "CASE WHEN p.close - r.close > 0 THEN p.close - r.close WHEN p.close - r.close <= 0 THEN 0D END"


def exponential(bars: DataFrame, rsi_n: int = 14, fast: int = 12, slow: int = 26, signal: int = 9, atr_n: int = 14, days: int = scan.DAYS) -> DataFrame:
    """bars with rsi, macd, macd_signal, macd_hist and atr, by scans over chunks of each ticker's days.

    rsi comes from smoothed gains and losses; it is 50 where there is no loss or too little history, so a pure rise has 50 too.
    """
    span = lambda n: 2.0 / (n + 1)
    out = bars.withColumns({c: present(F.col(c)) for c in ("high", "low", "close")})
    out = scan.weighted(out, "date", ("ticker",), {
        "_gain": scan.Weighted(GAIN, 1 / rsi_n, True, rsi_n), "_loss": scan.Weighted(LOSS, 1 / rsi_n, True, rsi_n), "_fast": scan.Weighted("r.close", span(fast)),
        "_slow": scan.Weighted("r.close", span(slow)), "atr": scan.Weighted(TRUE_RANGE, span(atr_n), least=atr_n),
    }, days)
    out = scan.weighted(out, "date", ("ticker",), {"macd_signal": scan.Weighted("r._fast - r._slow", span(signal))}, days)
    out = out.withColumn("macd", F.col("_fast") - F.col("_slow"))
    rsi = F.coalesce(100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))), F.lit(50.0))
    return out.select(*bars.columns, rsi.alias("rsi"), "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"), "atr")


def add_stoch_rsi(with_rsi: DataFrame, n: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    """stoch_k and stoch_d, 0.5 where missing; d averages k before that filling."""
    out = with_rsi.withColumns({"_lo": wf.rolling_min(F.col("rsi"), n, series()), "_hi": wf.rolling_max(F.col("rsi"), n, series())})
    out = out.withColumn("_raw", ratio(F.col("rsi") - F.col("_lo"), F.col("_hi") - F.col("_lo")))
    out = out.withColumn("_k", wf.sma(F.col("_raw"), smooth_k, series()))
    out = out.withColumn("_d", wf.sma(F.col("_k"), smooth_d, series()))
    return out.withColumns({"stoch_k": F.coalesce("_k", F.lit(0.5)), "stoch_d": F.coalesce("_d", F.lit(0.5))}).drop("_lo", "_hi", "_raw", "_k", "_d")


def atr_percentile(with_atr: DataFrame, lookback: int = 252, least: int = 20) -> DataFrame:
    """(ticker, atr_percentile, atr_regime): the share of the last ATRs strictly below the last one."""
    recent = with_atr.withColumn("_n", wf.from_end(["ticker"])).where(F.col("_n") <= lookback).where("atr is not null")
    now = recent.withColumn("_now", F.first("atr").over(W.partitionBy("ticker").orderBy("_n")))
    out = now.groupBy("ticker").agg(F.count("*").alias("_have"), (F.avg((F.col("atr") < F.col("_now")).cast("double")) * 100).alias("_p"))
    out = with_atr.select("ticker").distinct().join(out, "ticker", "left")
    short = F.coalesce(F.col("_have") < least, F.lit(True))
    regime = F.when(short, "normal").when(F.col("_p") < 25, "compression").when(F.col("_p") > 75, "expansion").otherwise("normal")
    return out.select("ticker", F.when(short, 50.0).otherwise(half_even(F.col("_p"), 1)).alias("atr_percentile"), regime.alias("atr_regime"))


def last_row(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_n", wf.from_end(["ticker"])).where("_n = 1").drop("_n")
