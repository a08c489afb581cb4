"""A panel refresh end to end: what to fetch, which source serves each ticker, upsert, clean, what stays unavailable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlake.operators import bars as ops
from marketlake.operators.membership import members_between
from marketlake.sources import versions


@dataclass(frozen=True)
class Refresh:
    panel: DataFrame
    unavailable: DataFrame


def refresh(requested: DataFrame, landed: DataFrame, renamed: DataFrame, retried: DataFrame, renames: DataFrame, path: str, cached: DataFrame | None = None,
            fallback: DataFrame | None = None, known_unavailable: DataFrame | None = None, least: int = ops.MIN_HISTORY) -> Refresh:
    """requested and known_unavailable hold tickers; landed, renamed (under new symbols), retried and fallback hold bars.

    What landed is first upserted into what is cached of the requested tickers, so a batch of a few days adds these days.
    A ticker is served from there if the cache knew it or if it now has `least` closes. Any other takes all its bars from
    the first source that has a usable series: the renamed symbol, the retry, then the fallback, whose bars are trimmed to
    the dates of the panel. Tickers that no source serves join the list of unavailable ones, which is never forgotten; one
    that the cache knew never does. The choice of sources and the panel before cleaning are committed as versions under
    `path`: results read the versions of their own run, whatever is committed later.
    """
    spark = landed.sparkSession
    active, asked = ops.active_renames(renames), requested.select("ticker").distinct()
    first = landed.join(asked, "ticker", "left_semi")
    known = None
    if cached is not None:
        cached = cached.join(asked, "ticker", "left_semi")
        known = cached.select("ticker").distinct().withColumn("_cached", F.lit(True))
        first = ops.upsert(cached, first.select(*cached.columns))
    sources = [first, ops.under_old_names(renamed, renames), retried]
    if fallback is not None:
        sources.append(ops.trim_to(fallback, first))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_rank", F.lit(n)) for n, s in enumerate(sources)])
    # one row per ticker and source: small beside the bars, and all that the choice needs
    stats = every.groupBy("ticker", "_rank").agg(F.count("close").alias("_n"), F.avg(F.col("close").isNotNull().cast("double")).alias("_known"))
    stats = stats.join(known, "ticker", "left") if known is not None else stats.withColumn("_cached", F.lit(None).cast("boolean"))
    usable = F.when(F.col("_rank") == 0, F.coalesce("_cached", F.lit(False)) | (F.col("_n") >= least)).otherwise(F.col("_known") > 0.5)
    of_ticker = stats.withColumn("_ok", usable).groupBy("ticker").agg(
        F.max(F.col("_rank") == 0).alias("_landed"), F.max((F.col("_rank") == 0) & F.col("_ok")).alias("_valid"), F.array_sort(F.collect_set(F.when(F.col("_ok"), F.col("_rank")))).alias("_ranks")
    )
    valid_new = of_ticker.where("_valid").select(F.col("ticker").alias("new_ticker"))
    blocked = active.join(valid_new, "new_ticker", "left_semi").select(F.col("old_ticker").alias("ticker"), F.lit(True).alias("_blocked"))
    choice = of_ticker.where("_landed").join(blocked, "ticker", "left")
    ranks = F.filter("_ranks", lambda r: ~(F.coalesce(F.col("_blocked"), F.lit(False)) & (r == 1)))
    choice = versions.commit(choice.select("ticker", F.get(ranks, 0).alias("_rank")), f"{path}/sources").read(spark)
    panel = every.join(choice.where("_rank is not null"), ["ticker", "_rank"], "left_semi").drop("_rank")
    panel = versions.commit(panel, f"{path}/panel").read(spark)
    lost = choice.where("_rank is null").select("ticker")
    if known_unavailable is not None:
        lost = lost.unionByName(known_unavailable.select("ticker")).distinct()
    return Refresh(ops.clean(ops.dedupe_renamed(panel, renames), least=least), lost)


def load_universe(members: DataFrame, start: str, end: str, landed: DataFrame, **sources) -> Refresh:
    """refresh() of every ticker that was a member at any time of the window, gone ones too. No member is an error: an
    empty request would be served from whatever is cached."""
    asked = members_between(members, start, end)
    if asked.isEmpty():
        raise ValueError(f"no members between {start} and {end}")
    return refresh(asked, landed, **sources)


def landed_bars(spark, path: str, tickers: list[str] | None = None, after: str | None = None) -> DataFrame:
    """Bars from a landing zone; ticker and date reach the scan as pushed filters."""
    out = spark.read.parquet(path)
    if tickers:
        out = out.where(F.col("ticker").isin(tickers))
    if after:
        out = out.where(F.col("date") > F.lit(after).cast("date"))
    return out


def csv_bars(documents: DataFrame) -> DataFrame:
    """Bars of daily-history CSV bodies (key, body); a body without the Date header gives none."""
    csv = documents.where(F.startswith("body", F.lit("Date,")))
    lines = csv.select(F.col("key").alias("ticker"), F.explode(F.slice(F.split(F.trim("body"), r"\r?\n"), 2, 1 << 30)).alias("line"))
    p = F.from_csv("line", "date date, open double, high double, low double, close double, volume double")
    return lines.select("ticker", p["date"].alias("date"), *[p[f].alias(f) for f in ops.FIELDS]).where("date is not null")
