"""Long-form OHLCV bars (ticker, date, open, high, low, close, volume): cleaning, repair, upsert and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.functions.numeric import present, ratio

FIELDS = ("open", "high", "low", "close", "volume")
MIN_HISTORY = 252


def as_long(wide: DataFrame, date: str = "date", sep: str = "|") -> DataFrame:
    """A wide panel, columns ticker|field, to bars."""
    cols = [c for c in wide.columns if c != date]
    long = wide.unpivot(date, cols, "name", "value")
    parts = F.split("name", rf"\{sep}")
    return long.select(parts[0].alias("ticker"), F.col(date).alias("date"), parts[1].alias("field"), present(F.col("value")).alias("value")).groupBy("ticker", "date").pivot("field", list(FIELDS)).agg(F.first("value"))


def as_wide(bars: DataFrame, tickers: list[str], sep: str = "|") -> DataFrame:
    """bars to a wide panel of the named tickers."""
    wide = bars.groupBy("date").pivot("ticker", tickers).agg(*[F.first(f).alias(f) for f in FIELDS])
    return wide.select("date", *[F.col(f"{t}_{f}").alias(f"{t}{sep}{f}") for t in tickers for f in FIELDS])


def known_fields(bars: DataFrame) -> DataFrame:
    """Every NaN to null."""
    return bars.withColumns({f: present(F.col(f)) for f in FIELDS if f in bars.columns})


def sane(bars: DataFrame, positive_price: bool = True, positive_volume: bool = False) -> DataFrame:
    """Rows with any field, a close, prices in order. A null in a comparison drops the row."""
    out = known_fields(bars).dropna(how="all", subset=[f for f in FIELDS if f in bars.columns]).where("close is not null")
    if positive_price:
        out = out.where("close > 0")
    if positive_volume:
        out = out.where("volume > 0")
    if {"open", "high", "low"} <= set(bars.columns):
        out = out.where("high >= low and high >= close and high >= open and low <= close and low <= open")
    return out


def with_history(bars: DataFrame, least: int = MIN_HISTORY) -> DataFrame:
    """Bars of tickers with at least `least` rows. The counts are few rows, so the bars do not move again."""
    return bars.join(bars.groupBy("ticker").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("ticker"), "ticker", "left_semi")


def clean(bars: DataFrame, positive_price: bool = True, positive_volume: bool = False, least: int = MIN_HISTORY) -> DataFrame:
    return with_history(sane(bars, positive_price, positive_volume), least)


def usable(bars: DataFrame, share: float = 0.5) -> DataFrame:
    """Tickers of which more than `share` of the rows have a close."""
    return bars.groupBy("ticker").agg(F.avg(F.col("close").isNotNull().cast("double")).alias("_known")).where(F.col("_known") > share).select("ticker")


def dedupe_renamed(bars: DataFrame, renames: DataFrame) -> DataFrame:
    """Without the old ticker of each active rename whose old and new tickers are both there."""
    have = bars.select("ticker").distinct()
    active = active_renames(renames)
    both = active.join(have.withColumnRenamed("ticker", "new_ticker"), "new_ticker", "left_semi").join(have.withColumnRenamed("ticker", "old_ticker"), "old_ticker", "left_semi")
    return bars.join(both.select(F.col("old_ticker").alias("ticker")), "ticker", "left_anti")


def active_renames(renames: DataFrame, order: str | None = None) -> DataFrame:
    """Active rows; of rows that share an old ticker the last, by `order` if given, else the greatest new ticker."""
    by = F.col(order) if order else F.col("new_ticker")
    return renames.where("status = 'active'").groupBy("old_ticker").agg(F.max_by("new_ticker", by).alias("new_ticker"))


def under_old_names(found: DataFrame, renames: DataFrame) -> DataFrame:
    """Bars fetched under new symbols, keyed by the old ones."""
    return found.join(active_renames(renames), F.col("ticker") == F.col("new_ticker")).select(F.col("old_ticker").alias("ticker"), *[c for c in found.columns if c != "ticker"])


def trim_to(bars: DataFrame, reference: DataFrame) -> DataFrame:
    """Bars inside the dates of the reference."""
    bounds = reference.agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    return bars.join(F.broadcast(bounds), F.col("date").between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def cascade(*sources: DataFrame) -> DataFrame:
    """The first source with a usable series of a ticker gives all its bars."""
    ranked = [s.join(usable(s), "ticker", "left_semi").withColumn("_rank", F.lit(n)) for n, s in enumerate(sources)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    best = reduce(DataFrame.unionByName, [r.select("ticker", "_rank").distinct() for r in ranked]).groupBy("ticker").agg(F.min("_rank").alias("_rank"))
    return both.join(best, ["ticker", "_rank"], "left_semi").drop("_rank")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of rows that share ticker and date the new one."""
    return old.join(new.select("ticker", "date"), ["ticker", "date"], "left_anti").unionByName(new)


def one_per_day(bars: DataFrame, newest: str | None = None) -> DataFrame:
    """One bar for each ticker and date: that with the greatest `newest`, else with the greatest fields."""
    rest = [c for c in bars.columns if c not in ("ticker", "date")]
    if not rest:
        return bars.distinct()
    row = F.struct(*rest)
    best = F.max_by(row, F.struct(newest, row)) if newest else F.max(row)
    return bars.groupBy("ticker", "date").agg(best.alias("_row")).select("ticker", "date", *[F.col("_row")[c].alias(c) for c in rest]).select(*bars.columns)


def in_utc(bars: DataFrame, zone: str | None = None, date: str = "date") -> DataFrame:
    """bars with timestamps of a time zone turned to UTC, without a zone; of no zone they stay. Ordered by nothing."""
    at = F.col(date).cast("timestamp_ntz")
    return bars.withColumn(date, F.convert_timezone(F.lit(zone), F.lit("UTC"), at) if zone else at)


def of_ticker(bars: DataFrame, ticker: str) -> DataFrame:
    """One ticker's bars by date, without those of which every field is null; the filter reaches the scan."""
    fields = [f for f in FIELDS if f in bars.columns]
    return known_fields(bars.where(F.col("ticker") == ticker)).dropna(how="all", subset=fields).orderBy("date")


def newer(bars: DataFrame, known: DataFrame) -> DataFrame:
    """Bars after the last known date of their ticker; all of unknown tickers."""
    last = known.groupBy("ticker").agg(F.max("date").alias("_last"))
    return bars.join(last, "ticker", "left").where("_last is null or date > _last").drop("_last")


def to_fetch(requested: DataFrame, have: DataFrame, unavailable: DataFrame, renames: DataFrame) -> DataFrame:
    """Requested tickers not there yet, without those known to be unavailable, unless a rename may bring them."""
    hopeless = unavailable.join(active_renames(renames).select(F.col("old_ticker").alias("ticker")), "ticker", "left_anti")
    return requested.join(have, "ticker", "left_anti").join(hopeless, "ticker", "left_anti").distinct()


def panel_summary(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count_distinct("date").alias("trading_days"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n_bars"))


def jaccard(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """One row: similarity of two ticker sets; 1 where both are empty."""
    a, b = requested.select("ticker").distinct().withColumn("a", F.lit(1)), cached.select("ticker").distinct().withColumn("b", F.lit(1))
    both = a.join(b, "ticker", "full_outer").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_common"), F.count("*").alias("n_all"))
    return both.withColumn("similarity", F.coalesce(ratio(F.col("n_common").cast("double"), F.col("n_all").cast("double")), F.lit(1.0)))


def cache_valid(similarity: float, age_hours: float | None, same_period: bool, least: float = 0.9, most_hours: float = 24.0) -> bool:
    """A cache serves where it exists, is fresh, has nearly the same tickers and the same period."""
    return age_hours is not None and age_hours <= most_hours and similarity >= least and same_period
