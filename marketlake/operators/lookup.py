"""Reference data per ticker with an age: sector and market value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def sectors_and_caps(requested: DataFrame, cache: DataFrame) -> DataFrame:
    """Every requested ticker with its sector, or Unknown, and its market value, or null."""
    known = cache.select("ticker", "sector", "market_cap")
    return requested.select("ticker").join(known, "ticker", "left").select("ticker", F.coalesce("sector", F.lit(UNKNOWN)).alias("sector"), "market_cap")


def stale_or_missing(requested: DataFrame, cache: DataFrame, now: str, max_hours: float) -> DataFrame:
    """Requested tickers to fetch: not cached, or cached too long ago."""
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")) / 3600
    return requested.select("ticker").distinct().join(cache.where(age <= max_hours), "ticker", "left_anti")


def refreshed(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with fetched rows in place of old ones; other rows keep their own age."""
    return cache.join(fetched.select("ticker"), "ticker", "left_anti").unionByName(fetched)


def refresh_sectors(requested: DataFrame, cache: DataFrame, fetched: DataFrame, now: str) -> DataFrame:
    """The cache after a fetch (ticker, sector, market_cap, ok): a fetch that failed keeps what was known, else Unknown."""
    known = cache.select("ticker", F.col("sector").alias("_sector"), F.col("market_cap").alias("_cap"))
    new = fetched.join(requested.select("ticker").distinct(), "ticker", "left_semi").join(known, "ticker", "left")
    new = new.select(
        "ticker", F.coalesce(F.when(F.col("ok"), F.nullif(F.col("sector"), F.lit(""))), F.when(~F.col("ok"), F.col("_sector")), F.lit(UNKNOWN)).alias("sector"),
        F.when(F.col("ok"), F.col("market_cap")).otherwise(F.col("_cap")).alias("market_cap"), F.lit(now).cast("timestamp").alias("fetched_at"),
    )
    return refreshed(cache, new)


def listed(cached: DataFrame | None, age_hours: float | None, scraped: DataFrame | None, max_hours: float = 168.0) -> tuple[DataFrame, bool]:
    """(tickers, whether they are to be saved): a fresh cache serves; else what was scraped; else the old cache.

    scraped is None where the fetch failed; without any list that is an error.
    """
    if cached is not None and age_hours is not None and age_hours < max_hours:
        return cached, False
    if scraped is not None:
        return scraped, True
    if cached is None:
        raise RuntimeError("no list: the fetch failed and there is no cache")
    return cached, False
