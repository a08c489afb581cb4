"""Composite signal scores: the last bar's indicators, laddered into scores, levels, warnings and one nested record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlake.functions import windows as wf
from marketlake.functions.numeric import clamp, half_even
from marketlake.operators import indicators as ind


@dataclass(frozen=True)
class SignalConfig:
    rsi_n: int = 14
    rsi_low: float = 35
    rsi_ideal_low: float = 40
    rsi_ideal_high: float = 65
    rsi_high: float = 70
    bb_n: int = 20
    bb_k: float = 2.0
    sma_fast: int = 50
    sma_slow: int = 200
    slope_n: int = 20
    surge: float = 1.5
    volume_n: int = 20
    atr_n: int = 14
    roc_n: int = 20
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    w_primary: float = 0.60
    w_secondary: float = 0.30
    w_confirmation: float = 0.10

    @property
    def least_rows(self) -> int:
        return max(self.sma_slow, self.bb_n, self.atr_n) + 5


def _ladder(x: Column, steps: list[tuple[Column, float]], other: float, missing: float | None = None) -> Column:
    out = F.when(x.isNull(), missing) if missing is not None else None
    for cond, value in steps:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(other)


def latest_metrics(bars: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """One row per ticker: the last values of all indicators, and how many rows and closes there are."""
    S, c = ind.series(), F.col("close")
    x = ind.exponential(bars, cfg.rsi_n, cfg.macd_fast, cfg.macd_slow, cfg.macd_signal, cfg.atr_n)
    x = x.withColumns({"sma_f": wf.sma(c, cfg.sma_fast, S), "sma_s": wf.sma(c, cfg.sma_slow, S)})
    x = ind.add_obv(ind.add_volume_ratio(ind.add_roc(ind.add_bollinger(x, cfg.bb_n, cfg.bb_k), cfg.roc_n), cfg.volume_n))
    x = ind.add_slope(x, "sma_s", cfg.slope_n, "slope")
    x = x.withColumns({"hist_before": F.lag("macd_hist").over(S), "obv_change": wf.diff(F.col("obv"), 10, S), "bw_min": wf.rolling_min(F.col("bandwidth"), 50, S)})
    counts = bars.groupBy("ticker").agg(F.count("*").alias("n_rows"), F.count("close").alias("n_closes"))
    return counts.join(ind.last_row(x), "ticker", "left")


def scored(metrics: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """metrics with every component score, the composite, levels and warnings as flat columns."""
    price, slope, rsi, roc, pct_b = (F.col(k) for k in ("close", "slope", "rsi", "roc", "pct_b"))
    p = F.when(F.col("sma_s") > 0, (price - F.col("sma_s")) / F.col("sma_s")).otherwise(0.0)
    m = metrics.withColumn("p200", p)
    p = F.col("p200")
    above = F.when(p < 0, F.greatest(F.lit(0.0), half_even(5 + 20 * p, 2))).when(p > 0.20, F.greatest(F.lit(0.0), half_even(10 - 20 * (p - 0.2), 2))).otherwise(half_even(5 + 25 * p, 2))
    bullish, rising = F.col("macd") > F.col("macd_signal"), F.col("macd_hist") > F.col("hist_before")
    surge = F.col("volume_ratio")
    m = m.withColumns({
        "golden_cross": F.coalesce(F.col("sma_f") > F.col("sma_s"), F.lit(False)),
        "macd_bullish": F.coalesce(bullish, F.lit(False)),
        "bb_squeeze": F.coalesce((F.col("bandwidth") <= 1.05 * F.col("bw_min")) & (F.col("bw_min") > 0), F.lit(False)),
        "s_price": clamp(above, 0.0, 10.0),
        "s_slope": _ladder(slope, [(slope > 0.05, 10.0), (slope > 0.02, 8.0), (slope > 0, 6.0), (slope > -0.02, 4.0)], 1.0, 5.0),
        "s_rsi": _ladder(rsi, [(rsi > cfg.rsi_high, 2.0), (rsi.between(cfg.rsi_ideal_low, cfg.rsi_ideal_high), 9.0), (rsi < cfg.rsi_low, 4.0), (rsi < cfg.rsi_ideal_low, 6.0)], 5.0),
        "s_roc": _ladder(roc, [(roc > 0.10, 9.0), (roc > 0.05, 7.5), (roc > 0, 6.0), (roc > -0.05, 4.0)], 1.0, 5.0),
        "s_macd": F.when(bullish & rising, 9.0).when(bullish, 6.0).when(rising, 4.0).otherwise(2.0),
        "s_bb": _ladder(pct_b, [(pct_b.between(0.40, 0.80), 8.0), (pct_b > 0.80, 4.0), (pct_b < 0.20, 5.0)], 6.0, 5.0),
        "s_volume": F.when(surge >= cfg.surge, 9.0).when(surge >= 1.2, 7.0).when(surge >= 0.8, 5.0).otherwise(3.0),
        "s_obv": F.when(F.col("obv_change") > 0, 7.0).otherwise(3.0),
    })
    m = m.withColumns({"s_regime": F.when(F.col("golden_cross"), 8.0).otherwise(3.0), "s_squeeze": F.when(F.col("bb_squeeze"), 8.0).otherwise(5.0)})
    c = F.col
    m = m.withColumns({
        "primary": half_even(0.35 * c("s_price") + 0.30 * c("s_slope") + 0.25 * c("s_rsi") + 0.10 * c("s_regime"), 2),
        "secondary": half_even(0.45 * c("s_roc") + 0.30 * c("s_macd") + 0.15 * c("s_bb") + 0.10 * c("s_squeeze"), 2),
        "confirmation": half_even(0.65 * c("s_volume") + 0.35 * c("s_obv"), 2),
    })
    score = half_even(c("primary") * cfg.w_primary + c("secondary") * cfg.w_secondary + c("confirmation") * cfg.w_confirmation, 2)
    level = lambda k: half_even(price + k * c("atr"), 2)
    m = m.withColumns({
        "signal_score": score, "entry_low": level(-0.5), "entry_high": level(0.5), "stop_loss": level(-1.5),
        "target_1": level(2), "target_2": level(4), "target_3": level(6),
    })
    risk = price - c("stop_loss")
    warn = {"rsi_overbought": c("rsi") > 75, "price_below_sma50": price < c("sma_f"), "macd_bearish": ~c("macd_bullish"), "slope_negative": slope < 0}
    m = m.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in warn.items()})
    count = sum((c(k).cast("int") for k in warn), F.lit(0))
    return m.withColumns({
        "rr_ratio": F.when(risk > 0, half_even((c("target_2") - price) / risk, 2)),
        "setup": F.when(c("signal_score") >= 7.5, "🟢 Strong").when(c("signal_score") >= 5.5, "🟡 Watchlist").otherwise("🔴 Avoid"),
        "warning_count": count,
        "exit_status": F.when(count == 0, "🟢 Hold").when(count == 1, "🟡 Monitor").when(count == 2, "🟠 Prepare exit").otherwise("🔴 Exit"),
        "error": F.when(c("n_closes") == 0, "Close series is empty").when(c("n_rows") < cfg.least_rows, "Not enough historical data"),
    })


def _metric(value: Column, score: str, label: Column) -> Column:
    return F.struct(value.alias("value"), F.col(score).alias("score"), label.alias("label"))


def _shown(col: Column, digits: int, sign: str = "") -> Column:
    """Digits after the point, ties to even."""
    return F.format_string(f"%{sign}.{digits}f", half_even(col, digits))


def _signed(col: Column, digits: int) -> Column:
    return F.coalesce(F.when(col.isNotNull(), F.concat(_shown(col * 100, digits, "+"), F.lit("%"))), F.lit("N/A"))


def record(s: DataFrame, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """One nested record per ticker; where there is an error, that and no score."""
    c = F.col
    yes = lambda b: F.when(b, "Yes").otherwise("No")
    primary = F.struct(
        _metric(half_even(c("p200") * 100, 2), "s_price", _signed(c("p200"), 1)).alias("price_vs_sma200"),
        _metric(half_even(c("slope") * 100, 2), "s_slope", _signed(c("slope"), 2)).alias("sma200_slope"),
        _metric(half_even(c("rsi"), 1), "s_rsi", _shown(c("rsi"), 1)).alias("rsi"),
        _metric(c("golden_cross"), "s_regime", yes(c("golden_cross"))).alias("golden_cross_regime"),
    )
    secondary = F.struct(
        _metric(half_even(c("roc") * 100, 2), "s_roc", _signed(c("roc"), 1)).alias("roc_20d"),
        _metric(half_even(c("macd"), 3), "s_macd", F.when(c("macd_bullish"), "Bullish").otherwise("Bearish")).alias("macd"),
        _metric(half_even(c("pct_b"), 2), "s_bb", F.coalesce(F.when(c("pct_b").isNotNull(), _shown(c("pct_b"), 2)), F.lit("N/A"))).alias("bb_pct_b"),
        _metric(c("bb_squeeze"), "s_squeeze", yes(c("bb_squeeze"))).alias("bb_squeeze"),
    )
    confirmation = F.struct(
        _metric(half_even(c("volume_ratio"), 2), "s_volume", F.concat(_shown(c("volume_ratio"), 1), F.lit("x avg"))).alias("volume_surge"),
        _metric(half_even(c("obv_change"), 0), "s_obv", F.when(c("obv_change") > 0, "Rising").otherwise("Falling")).alias("obv_trend"),
    )
    part = lambda score, weight, metrics: F.struct(c(score).alias("score"), F.lit(weight).alias("weight"), metrics.alias("metrics"))
    body = {
        "price": half_even(c("close"), 2), "signal_score": c("signal_score"), "setup": c("setup"), "atr": half_even(c("atr"), 2),
        "entry_zone": F.struct(c("entry_low").alias("low"), c("entry_high").alias("high")),
        "exit_targets": F.struct("stop_loss", "target_1", "target_2", "target_3", "rr_ratio"),
        "exit_warnings": F.struct(c("exit_status").alias("status"), "rsi_overbought", "price_below_sma50", "macd_bearish", "slope_negative", "warning_count"),
        "breakdown": F.struct(part("primary", cfg.w_primary, primary).alias("primary"), part("secondary", cfg.w_secondary, secondary).alias("secondary"), part("confirmation", cfg.w_confirmation, confirmation).alias("confirmation")),
    }
    return s.select("ticker", *[F.when(c("error").isNull(), v).alias(k) for k, v in body.items()], "error")


def signals_universe(bars: DataFrame, tickers: list[str] | None = None, cfg: SignalConfig = SignalConfig()) -> DataFrame:
    """Records of the named tickers, or of all; tickers without bars are left out."""
    some = bars.where(F.col("ticker").isin(tickers)) if tickers else bars
    return record(scored(latest_metrics(some, cfg), cfg), cfg)
