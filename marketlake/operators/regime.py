"""The daily market regime from volatility, trend and breadth; its settings and lookups by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from marketlake.functions import scan
from marketlake.functions import windows as wf
from marketlake.functions.numeric import half_even

# Fixed values: (bull, bear) bounds of each component, all strict.
VIX_BOUNDS = (20.0, 30.0)
SLOPE_BOUNDS = (0.00, -0.02)
BREADTH_BOUNDS = (0.60, 0.40)
SMA_DAYS = 200
SLOPE_DAYS = 20
VOTES = 2
MARGIN_DAYS = 300

# Settings of each regime.
CONFIG_COLUMNS = "regime string, signal_threshold double, top_n int, stop_atr double, target_atr double, max_hold int, use_trail boolean, trail_pct double, cash_pct double, w_primary_override double"
CONFIGS = [
    ("bull", 6.0, 5, 2.0, 6.0, 365, True, 0.08, 0.0, None),
    ("neutral", 6.5, 5, 1.5, 4.0, 180, False, 0.0, 0.10, None),
    ("bear", 7.5, 3, 1.0, 3.0, 90, False, 0.0, 0.50, 0.70),
]


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIGS, CONFIG_COLUMNS)


def breadth(bars: DataFrame, days: int = SMA_DAYS, strict_warmup: bool = False) -> DataFrame:
    """(date, breadth): share of tickers above their mean, on dates that half of all tickers have.

    Before a ticker has a mean it counts as below; with strict_warmup it does not count.
    """
    closes = bars.where("close is not null")
    n = bars.agg(F.count_distinct("ticker").alias("_tickers"))
    mean = wf.sma(F.col("close"), days, wf.series("ticker"))
    above = closes.withColumn("_mean", mean)
    if strict_warmup:
        above = above.where("_mean is not null")
    flag = F.coalesce((F.col("close") > F.col("_mean")).cast("double"), F.lit(0.0))
    by_date = above.groupBy("date").agg(F.count("*").alias("_n"), F.avg(flag).alias("breadth"))
    return by_date.crossJoin(F.broadcast(n)).where(F.col("_n") >= 0.5 * F.col("_tickers")).select("date", "breadth")


def slope(index: DataFrame, sma_days: int = SMA_DAYS, days: int = SLOPE_DAYS) -> DataFrame:
    """(date, slope) of the mean of an index series (date, close): one series, in blocks that overlap by what a frame looks back."""

    def rolled(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumn("_mean", wf.sma(F.col("close"), sma_days, w)).withColumn("slope", wf.pct_change(F.col("_mean"), days, w))

    known = index.where("close is not null").select("date", "close")
    return scan.in_blocks(known, "date", sma_days + days, rolled).where("slope is not null").select("date", "slope")


def align(vix: DataFrame | None = None, slopes: DataFrame | None = None, share: DataFrame | None = None) -> DataFrame:
    """(date, vix, slope, breadth): full outer on date, gaps filled forward. Each series may be absent."""
    given = [(d, c) for d, c in ((vix, "vix"), (slopes, "slope"), (share, "breadth")) if d is not None]
    if not given:
        raise ValueError("no series to classify")
    out = given[0][0].select("date", given[0][1])
    for d, c in given[1:]:
        out = out.join(d.select("date", c), "date", "full_outer")
    for c in {"vix", "slope", "breadth"} - {c for _, c in given}:
        out = out.withColumn(c, F.lit(None).cast("double"))
    return scan.fill_forward(out, ["vix", "slope", "breadth"], ["date"]).select("date", "vix", "slope", "breadth")


def classify(aligned: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Components, their votes and the regime of each date in [start, end]; bear is asked first."""
    if start:
        aligned = aligned.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        aligned = aligned.where(F.col("date") <= F.lit(end).cast("date"))

    def vote(c: str, bull, bear):
        return F.when(F.col(c).isNull(), "unknown").when(bull, "bull").when(bear, "bear").otherwise("neutral")

    v = {
        "vix_signal": vote("vix", F.col("vix") < VIX_BOUNDS[0], F.col("vix") > VIX_BOUNDS[1]),
        "slope_signal": vote("slope", F.col("slope") > SLOPE_BOUNDS[0], F.col("slope") < SLOPE_BOUNDS[1]),
        "breadth_signal": vote("breadth", F.col("breadth") > BREADTH_BOUNDS[0], F.col("breadth") < BREADTH_BOUNDS[1]),
    }
    out = aligned.withColumns(v)
    count = lambda says: sum((F.col(c).eqNullSafe(says).cast("int") for c in v), F.lit(0))
    out = out.withColumns({"bull_score": count("bull"), "bear_score": count("bear")})
    regime = F.when(F.col("bear_score") >= VOTES, "bear").when(F.col("bull_score") >= VOTES, "bull").otherwise("neutral")
    return out.select(
        "date", half_even(F.col("vix"), 1).alias("vix"), "vix_signal", half_even(F.col("slope") * 100, 2).alias("slope"), "slope_signal",
        half_even(F.col("breadth") * 100, 1).alias("breadth"), "breadth_signal", "bull_score", "bear_score", regime.alias("regime"),
    )


def detect(bars: DataFrame, start: str, end: str, universe: DataFrame | None = None, vix: str = "^VIX", index: str = "SPY") -> DataFrame:
    """classify() from bars alone: the volatility and index tickers, and breadth over a universe of bars if given.

    Bars are read from MARGIN_DAYS before the window, for the long mean, to a few days after it.
    """
    inside = F.col("date").between(F.date_sub(F.lit(start).cast("date"), MARGIN_DAYS), F.date_add(F.lit(end).cast("date"), 5))
    near = bars.where(inside)
    level = near.where((F.col("ticker") == vix) & F.col("close").isNotNull()).select("date", F.col("close").alias("vix"))
    trend = slope(near.where(F.col("ticker") == index).select("date", "close"))
    return classify(align(level, trend, None if universe is None else breadth(universe.where(inside))), start, end)


def as_of(asked: DataFrame, regimes: DataFrame) -> DataFrame:
    """asked (date and more) with the regime of that day or the last before it; neutral before the first.

    Distinct dates, few however many rows ask, are put in line with the regimes and filled forward; no row is compared
    with every regime.
    """
    dates = asked.select("date").where("date is not null").distinct()
    both = regimes.select("date", "regime", F.lit(0).alias("asked")).unionByName(dates.select("date", F.lit(None).cast("string").alias("regime"), F.lit(1).alias("asked")))
    filled = scan.fill_forward(both, ["regime"], ["date", "asked"]).where("asked = 1").select("date", "regime")
    return asked.drop("regime").join(filled, "date", "left").withColumn("regime", F.coalesce("regime", F.lit("neutral")))


def with_config(dated: DataFrame) -> DataFrame:
    """Rows with a regime, and its settings."""
    return dated.join(F.broadcast(configs(dated.sparkSession)), "regime")


def summary(regimes: DataFrame) -> DataFrame:
    """Days and percentage of bull, neutral, bear, in that order; none is zero."""
    dim = regimes.sparkSession.createDataFrame([(0, "bull"), (1, "neutral"), (2, "bear")], "nth int, regime string")
    n = regimes.groupBy("regime").agg(F.count("*").alias("days"))
    total = regimes.agg(F.count("*").alias("_total"))
    out = F.broadcast(dim).join(n, "regime", "left").crossJoin(F.broadcast(total))
    days = F.coalesce("days", F.lit(0))
    return out.select("nth", "regime", days.alias("days"), F.when(F.col("_total") > 0, half_even(100.0 * days / F.col("_total"), 1)).otherwise(0.0).alias("pct"))
