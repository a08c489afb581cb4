"""Queries over bars: cleaning, indicators, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions import windows as wf
from marketlake.functions.numeric import half_even
from marketlake.operators import bars as ops
from marketlake.operators import indicators as ind
from marketlake.operators import signals
from marketlake.plans import sql
from marketlake.sources.tables import bars, nation_bars, read


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: half_even(F.col(c), digits) for c in cols})


def bars_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean(bars(spark, sf_dir)).select("ticker", "date", *ops.FIELDS)


def panel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.panel_summary(ops.clean(bars(spark, sf_dir), positive_volume=True))


def sma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: cleaned bars, two means and Bollinger bands at the last date of each ticker."""
    x = ind.last_row(ind.add_bollinger(ind.add_smas(ops.clean(bars(spark, sf_dir)), 50, 200)))
    x = x.select("ticker", "date", "close", "sma50", "sma200", "pct_b", (F.col("sma50") > F.col("sma200")).alias("golden_cross"))
    return rounded(x, "close", "sma50", "sma200", "pct_b")


def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ind.add_bollinger(bars(spark, sf_dir)).select("ticker", "date", "bb_mid", "bb_upper", "bb_lower", "pct_b", "bandwidth")
    return rounded(x, "bb_mid", "bb_upper", "bb_lower", "pct_b", "bandwidth")


def rolling_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame function in one pass over one sort."""
    S, c = ind.series(), F.col("close")
    x = ind.add_williams_r(ind.add_obv(ind.add_roc(ind.add_volume_ratio(bars(spark, sf_dir)))))
    x = x.withColumns({"std20": wf.rolling_std(c, 20, S), "min14": wf.rolling_min(c, 14, S), "max14": wf.rolling_max(c, 14, S), "diff10": wf.diff(c, 10, S), "sma200": wf.sma(c, 200, S)})
    x = ind.add_slope(x, "sma200")
    cols = ["std20", "min14", "max14", "diff10", "roc", "slope", "obv", "williams_r", "volume_ratio"]
    return rounded(x.select("ticker", "date", *cols), *cols)


def exponential_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["rsi", "macd", "macd_signal", "macd_hist", "atr"]
    return rounded(ind.last_row(ind.exponential(bars(spark, sf_dir))).select("ticker", "date", *cols), *cols)


def stoch_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ind.add_stoch_rsi(ind.exponential(bars(spark, sf_dir)))
    return rounded(x.select("ticker", "date", "rsi", "stoch_k", "stoch_d"), "rsi", "stoch_k", "stoch_d")


def atr_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.atr_percentile(ind.exponential(bars(spark, sf_dir)))


def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = signals.scored(signals.latest_metrics(ops.clean(bars(spark, sf_dir))))
    cols = ["s_price", "s_slope", "s_rsi", "s_regime", "s_roc", "s_macd", "s_bb", "s_squeeze", "s_volume", "s_obv", "primary", "secondary", "confirmation", "signal_score"]
    levels = ["entry_low", "entry_high", "stop_loss", "target_1", "target_2", "target_3", "rr_ratio"]
    return s.select("ticker", *cols, *levels, "setup", "warning_count", "exit_status", "error")


def signal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested record of every ticker, a few leaves of it unnested again."""
    r = signals.signals_universe(ops.clean(bars(spark, sf_dir)))
    b = F.col("breakdown")
    return r.select(
        "ticker", "price", "signal_score", F.col("exit_warnings.status").alias("status"), F.col("entry_zone.low").alias("entry_low"),
        b["primary"]["metrics"]["price_vs_sma200"]["label"].alias("price_label"), b["secondary"]["metrics"]["bb_pct_b"]["label"].alias("pct_b_label"),
        b["confirmation"]["metrics"]["volume_surge"]["label"].alias("volume_label"), "error",
    )


def panel_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long to wide and back, for every ticker of the panel, and the closes that came through. The columns of a wide
    panel are its tickers, so their list, as long as the panel is wide, is read first."""
    b = bars(spark, sf_dir)
    back = ops.as_long(ops.as_wide(b, [r[0] for r in b.select("ticker").distinct().orderBy("ticker").collect()]))
    return back.where("close is not null").groupBy("ticker").agg(F.count("*").alias("n"), half_even(F.sum("volume"), 3).alias("volume"), F.max("date").alias("last_date"))


def rename_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    renames = spark.createDataFrame([("AF", "RF", "active"), ("NF", "ZZ", "active"), ("NO", "RF", "retired")], "old_ticker string, new_ticker string, status string")
    return ops.dedupe_renamed(bars(spark, sf_dir), renames).groupBy("ticker").agg(F.count("*").alias("n"))


def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first source with broken closes gives way to a second, ticker by ticker."""
    b = bars(spark, sf_dir)
    broken = b.withColumn("close", F.when(~((F.col("ticker") == "AF") & (F.dayofmonth("date") > 10)), F.col("close")))
    return ops.cascade(broken.where("ticker != 'NO'"), b).groupBy("ticker").agg(F.count("close").alias("n_closes"), F.count("*").alias("n"))


def incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New days appended, re-sent days replaced, for tickers known before."""
    b = bars(spark, sf_dir)
    old = b.where("date < date '1998-01-01'").withColumn("volume", F.lit(0.0))
    return ops.upsert(old, b.where("date >= date '1997-12-15'")).groupBy("ticker").agg(F.count("*").alias("n"), half_even(F.sum("volume"), 3).alias("volume"), F.max("date").alias("last_date"))


def cache_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_name").alias("ticker"), "c_nationkey")
    return rounded(ops.jaccard(c.where("c_nationkey < 20"), c.where("c_nationkey > 2")).select("n_common", "n_all", "similarity"), "similarity")


def breadth_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable tickers of the wide panel."""
    return ops.usable(nation_bars(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        bars_clean, panel_summary, sma_cross, bollinger, rolling_functions, exponential_latest, stoch_rsi, atr_percentile, signal_score, signal_records, panel_wide,
        rename_dedupe, source_cascade, incremental_upsert, cache_jaccard, breadth_tickers,
    )
}

_CLEAN = """
sane AS (SELECT * FROM bars WHERE close IS NOT NULL AND close > 0 AND high >= low AND high >= close AND high >= open AND low <= close AND low <= open),
clean AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n_rows FROM sane) WHERE n_rows >= 252)"""

_R = lambda c, d=6: f"round_even({c}, {d}) + 0.0 AS {c}"

_BB = f"""
bb0 AS (SELECT *, {sql.sma('close', 20, 'bb_mid')}, {sql.sma('close', 20, 'dev', fn='stddev_samp')} FROM {{src}}),
bb AS (SELECT *, bb_mid + 2 * dev AS bb_upper, bb_mid - 2 * dev AS bb_lower,
  (close - (bb_mid - 2 * dev)) / nullif((bb_mid + 2 * dev) - (bb_mid - 2 * dev), 0) AS pct_b, ((bb_mid + 2 * dev) - (bb_mid - 2 * dev)) / nullif(bb_mid, 0) AS bandwidth FROM bb0)"""


def _exponential(src: str) -> str:
    """ex: ticker with lists ds, rsi, macd, sig, hist, atr, one entry per bar."""
    return f"""
p AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS pc FROM {src}),
l AS (SELECT ticker, list(date ORDER BY date) AS ds, list(close ORDER BY date) AS cs, list(greatest(high - low, abs(high - pc), abs(low - pc)) ORDER BY date) AS tr,
  list(greatest(close - pc, 0) ORDER BY date) FILTER (WHERE pc IS NOT NULL) AS up, list(greatest(pc - close, 0) ORDER BY date) FILTER (WHERE pc IS NOT NULL) AS down FROM p GROUP BY ticker),
l2 AS (SELECT *, {sql.ema('cs', 12)} AS f, {sql.ema('cs', 26)} AS s, {sql.ema('tr', 14)} AS atr, {sql.decayed('up', 14)} AS g, {sql.decayed('down', 14)} AS d FROM l),
l3 AS (SELECT *, list_transform(range(1, len(f) + 1), lambda i: f[i] - s[i]) AS macd FROM l2),
ex AS (SELECT *, {sql.ema('macd', 9)} AS sig,
  list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN i < 15 OR d[i - 1] = 0 THEN 50.0 ELSE 100 - 100 / (1 + g[i - 1] / d[i - 1]) END) AS rsi FROM l3),
xs AS (SELECT ticker, unnest(ds) AS date, unnest(rsi) AS rsi, unnest(macd) AS macd, unnest(sig) AS macd_signal,
  unnest(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i >= 14 THEN atr[i] END)) AS atr FROM ex)"""


_SCORE = f"""
ix AS (SELECT c.*, xs.rsi, xs.macd, xs.macd_signal, xs.macd - xs.macd_signal AS hist, xs.atr FROM bb c JOIN xs USING (ticker, date)),
iy AS (SELECT *, {sql.sma('close', 50, 'sma50')}, {sql.sma('close', 200, 'sma200')}, {sql.sma('volume', 20, 'va')}, {sql.sma('bandwidth', 50, 'bwm', fn='min')},
  close / nullif(lag(close, 20) OVER w, 0) - 1 AS roc, lag(hist) OVER w AS hist0, sum(st) OVER (w ROWS UNBOUNDED PRECEDING) AS obv
  FROM (SELECT *, coalesce(sign(close - lag(close) OVER (PARTITION BY ticker ORDER BY date)), 0) * volume AS st FROM ix) WINDOW w AS (PARTITION BY ticker ORDER BY date)),
iz AS (SELECT *, sma200 / nullif(lag(sma200, 20) OVER w, 0) - 1 AS slope, obv - lag(obv, 10) OVER w AS od, {sql.LAST} AS n, count(*) OVER (PARTITION BY ticker) AS nr FROM iy WINDOW w AS (PARTITION BY ticker ORDER BY date)),
m AS (SELECT *, CASE WHEN sma200 > 0 THEN (close - sma200) / sma200 ELSE 0 END AS p, CASE WHEN va > 0 THEN volume / va ELSE 1 END AS vr FROM iz WHERE n = 1),
s AS (SELECT *,
  greatest(0, least(10, CASE WHEN p < 0 THEN greatest(0, round_even(5 + 20 * p, 2)) WHEN p > 0.2::DOUBLE THEN greatest(0, round_even(10 - 20 * (p - 0.2::DOUBLE), 2)) ELSE round_even(5 + 25 * p, 2) END)) AS s_price,
  CASE WHEN slope IS NULL THEN 5 WHEN slope > 0.05 THEN 10 WHEN slope > 0.02 THEN 8 WHEN slope > 0 THEN 6 WHEN slope > -0.02 THEN 4 ELSE 1 END AS s_slope,
  CASE WHEN rsi > 70 THEN 2 WHEN rsi BETWEEN 40 AND 65 THEN 9 WHEN rsi < 35 THEN 4 WHEN rsi < 40 THEN 6 ELSE 5 END AS s_rsi,
  CASE WHEN sma50 > sma200 THEN 8 ELSE 3 END AS s_regime,
  CASE WHEN roc IS NULL THEN 5 WHEN roc > 0.10 THEN 9 WHEN roc > 0.05 THEN 7.5 WHEN roc > 0 THEN 6 WHEN roc > -0.05 THEN 4 ELSE 1 END AS s_roc,
  CASE WHEN macd > macd_signal AND hist > hist0 THEN 9 WHEN macd > macd_signal THEN 6 WHEN hist > hist0 THEN 4 ELSE 2 END AS s_macd,
  CASE WHEN pct_b IS NULL THEN 5 WHEN pct_b BETWEEN 0.40 AND 0.80 THEN 8 WHEN pct_b > 0.80 THEN 4 WHEN pct_b < 0.20 THEN 5 ELSE 6 END AS s_bb,
  CASE WHEN bandwidth <= 1.05::DOUBLE * bwm AND bwm > 0 THEN 8 ELSE 5 END AS s_squeeze,
  CASE WHEN vr >= 1.5 THEN 9 WHEN vr >= 1.2 THEN 7 WHEN vr >= 0.8 THEN 5 ELSE 3 END AS s_volume,
  CASE WHEN od > 0 THEN 7 ELSE 3 END AS s_obv FROM m),
s2 AS (SELECT *, round_even(0.35::DOUBLE * s_price + 0.30::DOUBLE * s_slope + 0.25::DOUBLE * s_rsi + 0.10::DOUBLE * s_regime, 2) AS "primary",
  round_even(0.45::DOUBLE * s_roc + 0.30::DOUBLE * s_macd + 0.15::DOUBLE * s_bb + 0.10::DOUBLE * s_squeeze, 2) AS secondary, round_even(0.65::DOUBLE * s_volume + 0.35::DOUBLE * s_obv, 2) AS confirmation,
  round_even(close - 0.5 * atr, 2) AS entry_low, round_even(close + 0.5 * atr, 2) AS entry_high, round_even(close - 1.5 * atr, 2) AS stop_loss,
  round_even(close + 2 * atr, 2) AS target_1, round_even(close + 4 * atr, 2) AS target_2, round_even(close + 6 * atr, 2) AS target_3,
  CAST(coalesce(rsi > 75, false) AS INT) + CAST(coalesce(close < sma50, false) AS INT) + CAST(NOT coalesce(macd > macd_signal, false) AS INT) + CAST(coalesce(slope < 0, false) AS INT) AS warning_count FROM s),
s3 AS (SELECT *, round_even("primary" * 0.6::DOUBLE + secondary * 0.3::DOUBLE + confirmation * 0.1::DOUBLE, 2) AS signal_score, CASE WHEN close > stop_loss THEN round_even((target_2 - close) / (close - stop_loss), 2) END AS rr_ratio FROM s2)"""

_WITH_SCORE = f"WITH {sql.BARS},{_CLEAN},{_BB.format(src='clean')},{_exponential('clean')},{_SCORE}"

ORACLES = {
    "bars_clean": f"WITH {sql.BARS},{_CLEAN} SELECT ticker, date, open, high, low, close, volume FROM clean",
    "panel_summary": f"WITH {sql.BARS},{_CLEAN} SELECT count(DISTINCT date) AS trading_days, count(DISTINCT ticker) AS tickers, min(date) AS first_date, max(date) AS last_date, count(*) AS n_bars FROM clean WHERE volume > 0",
    "sma_cross": f"WITH {sql.BARS},{_CLEAN},{_BB.format(src='clean')}, x AS (SELECT *, {sql.sma('close', 50, 'sma50')}, {sql.sma('close', 200, 'sma200')}, {sql.LAST} AS n FROM bb) "
    f"SELECT ticker, date, {_R('close')}, {_R('sma50')}, {_R('sma200')}, {_R('pct_b')}, sma50 > sma200 AS golden_cross FROM x WHERE n = 1",
    "bollinger": f"WITH {sql.BARS},{_BB.format(src='bars')} SELECT ticker, date, {_R('bb_mid')}, {_R('bb_upper')}, {_R('bb_lower')}, {_R('pct_b')}, {_R('bandwidth')} FROM bb",
    "rolling_functions": f"""WITH {sql.BARS},
x AS (SELECT *, {sql.sma('close', 20, 'std20', fn='stddev_samp')}, {sql.sma('close', 14, 'min14', fn='min')}, {sql.sma('close', 14, 'max14', fn='max')}, close - lag(close, 10) OVER w AS diff10,
  close / nullif(lag(close, 20) OVER w, 0) - 1 AS roc, {sql.sma('close', 200, 'sma200')}, {sql.sma('high', 14, 'hh', fn='max')}, {sql.sma('low', 14, 'll', fn='min')}, {sql.sma('volume', 20, 'va')},
  coalesce(sign(close - lag(close) OVER w), 0) * volume AS st FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
y AS (SELECT *, sma200 / nullif(lag(sma200, 20) OVER w, 0) - 1 AS slope, sum(st) OVER (w ROWS UNBOUNDED PRECEDING) AS obv, coalesce((hh - close) / nullif(hh - ll, 0) * -100, -50) AS williams_r,
  CASE WHEN va > 0 THEN volume / va ELSE 1 END AS volume_ratio FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, date, {', '.join(_R(c) for c in ("std20", "min14", "max14", "diff10", "roc", "slope", "obv", "williams_r", "volume_ratio"))} FROM y""",
    "exponential_latest": f"WITH {sql.BARS},{_exponential('bars')}, y AS (SELECT *, macd - macd_signal AS macd_hist, {sql.LAST} AS n FROM xs) "
    f"SELECT ticker, date, {', '.join(_R(c) for c in ('rsi', 'macd', 'macd_signal', 'macd_hist', 'atr'))} FROM y WHERE n = 1",
    "stoch_rsi": f"""WITH {sql.BARS},{_exponential('bars')},
a AS (SELECT *, {sql.sma('rsi', 14, 'lo', fn='min')}, {sql.sma('rsi', 14, 'hi', fn='max')} FROM xs), b AS (SELECT *, (rsi - lo) / nullif(hi - lo, 0) AS raw FROM a),
c AS (SELECT *, {sql.sma('raw', 3, 'k')} FROM b), d AS (SELECT *, {sql.sma('k', 3, 'dd')} FROM c)
SELECT ticker, date, {_R('rsi')}, round_even(coalesce(k, 0.5::DOUBLE), 6) + 0.0 AS stoch_k, round_even(coalesce(dd, 0.5::DOUBLE), 6) + 0.0 AS stoch_d FROM d""",
    "atr_percentile": f"""WITH {sql.BARS},{_exponential('bars')}, r AS (SELECT ticker, date, atr, {sql.LAST} AS n FROM xs),
h AS (SELECT ticker, atr, first(atr) OVER (PARTITION BY ticker ORDER BY n) AS now FROM r WHERE n <= 252 AND atr IS NOT NULL),
g AS (SELECT ticker, count(*) AS c, avg(CASE WHEN atr < now THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS pct FROM h GROUP BY ticker)
SELECT ticker, CASE WHEN c < 20 THEN 50.0 ELSE round_even(pct, 1) END AS atr_percentile, CASE WHEN c < 20 THEN 'normal' WHEN pct < 25 THEN 'compression' WHEN pct > 75 THEN 'expansion' ELSE 'normal' END AS atr_regime FROM g""",
    "signal_score": f"""{_WITH_SCORE} SELECT ticker, CAST(s_price AS DOUBLE) AS s_price, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('s_slope', 's_rsi', 's_regime', 's_roc', 's_macd', 's_bb', 's_squeeze', 's_volume', 's_obv'))},
  "primary", secondary, confirmation, signal_score, entry_low, entry_high, stop_loss, target_1, target_2, target_3, rr_ratio,
  CASE WHEN signal_score >= 7.5 THEN '🟢 Strong' WHEN signal_score >= 5.5 THEN '🟡 Watchlist' ELSE '🔴 Avoid' END AS setup, warning_count,
  CASE warning_count WHEN 0 THEN '🟢 Hold' WHEN 1 THEN '🟡 Monitor' WHEN 2 THEN '🟠 Prepare exit' ELSE '🔴 Exit' END AS exit_status, CAST(NULL AS VARCHAR) AS error FROM s3""",
    "signal_records": f"""{_WITH_SCORE} SELECT ticker, round_even(close, 2) AS price, signal_score, CASE warning_count WHEN 0 THEN '🟢 Hold' WHEN 1 THEN '🟡 Monitor' WHEN 2 THEN '🟠 Prepare exit' ELSE '🔴 Exit' END AS status, entry_low,
  printf('%+.1f%%', p * 100) AS price_label, printf('%.2f', pct_b) AS pct_b_label, printf('%.1fx avg', vr) AS volume_label, CAST(NULL AS VARCHAR) AS error FROM s3""",
    "panel_wide": f"WITH {sql.BARS} SELECT ticker, count(*) AS n, round_even(sum(volume), 3) AS volume, max(date) AS last_date FROM bars GROUP BY ticker",
    "rename_dedupe": f"WITH {sql.BARS} SELECT ticker, count(*) AS n FROM bars WHERE NOT (ticker = 'AF' AND EXISTS (SELECT 1 FROM bars WHERE ticker = 'RF')) GROUP BY ticker",
    "source_cascade": f"""WITH {sql.BARS}, a AS (SELECT ticker, date, CASE WHEN NOT (ticker = 'AF' AND day(date) > 10) THEN close END AS close, 0 AS rank FROM bars WHERE ticker <> 'NO'),
u AS (SELECT * FROM a UNION ALL SELECT ticker, date, close, 1 FROM bars), ok AS (SELECT ticker, min(rank) AS rank FROM (SELECT ticker, rank FROM u GROUP BY ticker, rank HAVING avg(CASE WHEN close IS NULL THEN 0 ELSE 1 END) > 0.5) GROUP BY ticker)
SELECT ticker, count(close) AS n_closes, count(*) AS n FROM u JOIN ok USING (ticker, rank) GROUP BY ticker""",
    "incremental_upsert": f"WITH {sql.BARS} SELECT ticker, count(*) AS n, round_even(sum(CASE WHEN date >= DATE '1997-12-15' THEN volume ELSE 0 END), 3) AS volume, max(date) AS last_date FROM bars GROUP BY ticker",
    "cache_jaccard": """WITH a AS (SELECT DISTINCT c_name FROM customer WHERE c_nationkey < 20), b AS (SELECT DISTINCT c_name FROM customer WHERE c_nationkey > 2),
c AS (SELECT count(*) AS n FROM a JOIN b USING (c_name)), u AS (SELECT count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b))
SELECT c.n AS n_common, u.n AS n_all, round_even(c.n::DOUBLE / u.n, 6) AS similarity FROM c, u""",
    "breadth_tickers": f"WITH {sql.NATION_BARS} SELECT DISTINCT ticker FROM nb",
}
