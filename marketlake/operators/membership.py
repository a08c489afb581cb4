"""Point-in-time membership: snapshots and change events to validity intervals, and questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Index pages, the column that holds tickers, the exchange suffix.
INDEX_SOURCES = {
    "sp500": ("List_of_S%26P_500_companies", "Symbol", None),
    "nasdaq100": ("Nasdaq-100", "Ticker", None),
    "dow30": ("Dow_Jones_Industrial_Average", "Symbol", None),
    "russell2000": ("Russell_2000_Index", "Symbol", None),
    "dax40": ("DAX", "Ticker", ".DE"),
    "cac40": ("CAC_40", "Ticker", ".PA"),
    "eurostoxx50": ("Euro_Stoxx_50", "Ticker", None),
    "ftse100": ("FTSE_100_Index", "EPIC", ".L"),
    "aex25": ("AEX_index", "Symbol", ".AS"),
    "ftse_mib": ("FTSE_MIB", "Ticker", ".MI"),
    "ibex35": ("IBEX_35", "Ticker", ".MC"),
}
WITH_HISTORY = ("sp500",)


#: Days of a bin in which bars meet intervals.
BIN_DAYS = 64


def historic_tickers(cell: Column) -> Column:
    """A comma-joined cell to its distinct tickers: trimmed, -YYYYMM taken off, dots to dashes, upper case."""
    tidy = F.transform(F.split(F.coalesce(cell, F.lit("")), ","), lambda t: F.upper(F.replace(F.regexp_replace(F.trim(t), r"-\d{6}$", ""), F.lit("."), F.lit("-"))))
    return F.array_distinct(F.filter(tidy, lambda t: t != ""))


def valid_ticker(t: Column) -> Column:
    return (t != "") & ~t.rlike(r"^\[?\d+\]?$") & (F.length(t) <= 15)


def scraped_tickers(cells: DataFrame, index: str) -> DataFrame:
    """Sorted distinct tickers of raw table cells (cell): footnotes and numbers go, dot suffixes too; the index's suffix is added."""
    if index not in INDEX_SOURCES:
        raise ValueError(f"unknown index {index}")
    suffix = INDEX_SOURCES[index][2] or ""
    base = F.trim(F.split_part(F.trim("cell"), F.lit("."), F.lit(1)))
    return cells.where(valid_ticker(F.trim("cell"))).select(base.alias("ticker")).where("ticker != ''").select(F.concat("ticker", F.lit(suffix)).alias("ticker")).distinct().orderBy("ticker")


def snapshot_events(snapshots: DataFrame) -> DataFrame:
    """Snapshots (date, tickers array) to events (ticker, phase 0, date, nth, kind): runs of consecutive snapshots.

    kind 1 adds at a run's first snapshot, kind 0 removes at the first snapshot without the ticker. Only the list of
    dates is numbered in one place; the tickers are grouped by themselves.
    """
    w = W.partitionBy("_all").orderBy("date")
    dates = snapshots.select("date").distinct().withColumn("_all", F.lit(0)).select("date", F.row_number().over(w).alias("idx"), F.lead("date").over(w).alias("next"))
    rows = snapshots.join(dates, "date").select(F.explode("tickers").alias("ticker"), "date", "idx", "next").distinct()
    runs = rows.withColumn("g", F.col("idx") - F.row_number().over(W.partitionBy("ticker").orderBy("idx")))
    runs = runs.groupBy("ticker", "g").agg(F.min("date").alias("a"), F.max_by("next", "idx").alias("r"))
    kinds = F.array(F.struct(F.lit(1).alias("kind"), F.col("a").alias("date")), F.struct(F.lit(0).alias("kind"), F.col("r").alias("date")))
    return runs.select("ticker", F.explode(kinds).alias("e")).select("ticker", F.lit(0).alias("phase"), "e.date", F.lit(0).cast("long").alias("nth"), "e.kind").where("date is not null")


def change_events(changes: DataFrame) -> DataFrame:
    """Changes (date, nth, add, remove; comma-joined cells) to events of phase 1."""
    parts = [changes.select(F.explode(historic_tickers(F.col(c))).alias("ticker"), F.lit(1).alias("phase"), "date", "nth", F.lit(k).alias("kind")) for c, k in (("remove", 0), ("add", 1))]
    return parts[0].unionByName(parts[1])


def intervals(events: DataFrame) -> DataFrame:
    """(ticker, date_added, date_removed) from events; inside a row removals come before additions.

    Each removal closes a group. A group's last addition starts the interval, so adding an open ticker again moves its
    start; a removal of a ticker that is not open makes an interval of no length.
    """
    order = F.struct("phase", "date", "nth", "kind")
    w = W.partitionBy("ticker").orderBy("phase", "date", "nth", "kind").rowsBetween(W.unboundedPreceding, -1)
    g = events.withColumn("g", F.coalesce(F.sum((F.col("kind") == 0).cast("int")).over(w), F.lit(0))).withColumn("_o", order)
    out = g.groupBy("ticker", "g").agg(F.max_by(F.when(F.col("kind") == 1, F.col("date")), F.when(F.col("kind") == 1, F.col("_o"))).alias("_a"), F.max(F.when(F.col("kind") == 0, F.col("date"))).alias("date_removed"))
    return out.select("ticker", F.coalesce("_a", "date_removed").alias("date_added"), "date_removed")


def members_as_of(members: DataFrame, day: str) -> DataFrame:
    """Distinct tickers that are in on the day: added by then, not removed until after."""
    d = F.lit(day).cast("date")
    return members.where((F.col("date_added") <= d) & (F.col("date_removed").isNull() | (F.col("date_removed") > d))).select("ticker").distinct()


def members_between(members: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct tickers that were in at any time of the window, both ends included."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    return members.where((F.col("date_added") <= e) & (F.col("date_removed").isNull() | (F.col("date_removed") >= s))).select("ticker").distinct()


def tickers_of(members: DataFrame | None, index: str, scraped: DataFrame | None = None, day: str | None = None) -> DataFrame:
    """Current tickers of an index, or those of a day where history is kept."""
    if index not in INDEX_SOURCES:
        raise ValueError(f"unknown index {index}")
    if day is None:
        return scraped.select("ticker").distinct()
    if index not in WITH_HISTORY:
        raise NotImplementedError(f"no membership history for {index}")
    return members_as_of(members, day)


def all_ever(members: DataFrame) -> DataFrame:
    return members.select("ticker").distinct()


def coverage_days(members: DataFrame, start: str, end: str) -> DataFrame:
    """(ticker, days): days of the window that each ticker's intervals cover."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = members.where((F.col("date_added") <= e) & (F.col("date_removed").isNull() | (F.col("date_removed") >= s)))
    days = F.greatest(F.datediff(F.least(F.coalesce("date_removed", e), e), F.greatest("date_added", s)), F.lit(0))
    return inside.groupBy("ticker").agg(F.sum(days).alias("days"))


def coverage_gap(members: DataFrame, missing: DataFrame, start: str, end: str) -> DataFrame:
    """One row: total days, days of missing tickers and their percentage."""
    days = coverage_days(members, start, end).join(missing.select("ticker", F.lit(True).alias("_gone")).distinct(), "ticker", "left")
    out = days.agg(F.coalesce(F.sum("days"), F.lit(0)).alias("total_days"), F.coalesce(F.sum(F.when(F.col("_gone"), F.col("days"))), F.lit(0)).alias("missing_days"))
    return out.withColumn("missing_pct", F.when(F.col("total_days") > 0, 100.0 * F.col("missing_days") / F.col("total_days")).otherwise(0.0))


def coverage_top(members: DataFrame, missing: DataFrame, start: str, end: str, n: int = 15) -> DataFrame:
    """The missing tickers that would have covered most days."""
    return coverage_days(members, start, end).join(missing.select("ticker").distinct(), "ticker", "left_semi").orderBy(F.col("days").desc(), "ticker").limit(n)


def disjoint(members: DataFrame) -> DataFrame:
    """(ticker, date_added, date_removed): each ticker's days in, as intervals that neither meet nor overlap; those of no length go."""
    far = F.coalesce("date_removed", F.lit("9999-12-31").cast("date"))
    m = members.select("ticker", "date_added", far.alias("date_removed")).where("date_added < date_removed")
    w = W.partitionBy("ticker").orderBy("date_added", "date_removed")
    m = m.withColumn("_reached", F.max("date_removed").over(w.rowsBetween(W.unboundedPreceding, -1)))
    m = m.withColumn("_g", F.count_if(F.coalesce(F.col("date_added") > F.col("_reached"), F.lit(True))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return m.groupBy("ticker", "_g").agg(F.min("date_added").alias("date_added"), F.max("date_removed").alias("date_removed")).drop("_g")


def bars_in_universe(bars: DataFrame, members: DataFrame, days: int = BIN_DAYS) -> DataFrame:
    """Bars on days when their ticker was in.

    Disjoint intervals, cut to the dates of the bars, are spread over bins of days and meet the bars by ticker and bin, so a
    bar is compared with the few intervals of its bin, however many its ticker has.
    """
    bin_of = lambda d: F.floor(F.unix_date(d) / days)
    dates = bars.agg(F.min("date").alias("_from"), F.date_add(F.max("date"), 1).alias("_to"))  # one row
    m = disjoint(members).join(F.broadcast(dates), (F.col("date_added") < F.col("_to")) & (F.col("date_removed") > F.col("_from")))
    m = m.select(F.col("ticker").alias("_t"), F.greatest("date_added", "_from").alias("_in"), F.least("date_removed", "_to").alias("_out"))
    m = m.withColumn("_b", F.explode(F.sequence(bin_of("_in"), bin_of(F.date_sub("_out", 1)))))
    found = bars.withColumn("_bin", bin_of("date"))
    return found.join(m, (F.col("ticker") == F.col("_t")) & (F.col("_bin") == F.col("_b")) & (F.col("date") >= F.col("_in")) & (F.col("date") < F.col("_out")), "left_semi").drop("_bin")
