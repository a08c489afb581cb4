"""Option chains to sentiment: totals by side, put/call ratios, at-the-money volatility, signals, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.sources import files

#: A ticker's answer: its price, its expirations, and a chain or an error for each expiration that was asked for.
_CONTRACT = (
    "struct<strike: double, lastPrice: double, bid: double, ask: double, volume: double, openInterest: double, impliedVolatility: double,"
    " inTheMoney: boolean, contractSymbol: string, lastTradeDate: string>"
)
CHAINS = f"struct<price: double, expirations: array<string>, chains: array<struct<expiration: string, calls: array<{_CONTRACT}>, puts: array<{_CONTRACT}>>>>"
ERROR_CHARS = 50

NEAREST = 3
DAYS = (7, 60)
UNUSUAL = 2.0
# Bounds of the put/call ratio.
STRONG, BULL, BEAR = 1.5, 1.0, 0.5


def sides(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Two tables of contracts as one with option_type."""
    return calls.withColumn("option_type", F.lit("call")).unionByName(puts.withColumn("option_type", F.lit("put")), allowMissingColumns=True)


def in_window(contracts: DataFrame, today: str, days: tuple[int, int] = DAYS) -> DataFrame:
    """Contracts that expire inside the days; one whose expiration is no date goes."""
    return contracts.where(F.datediff(F.try_to_date("expiration"), F.lit(today).cast("date")).between(*days))


def atm_contracts(contracts: DataFrame, n: int = NEAREST) -> DataFrame:
    """Of each ticker, expiration and side the n strikes nearest the price; only then contracts without volatility go."""
    w = W.partitionBy("ticker", "expiration", "option_type").orderBy(F.abs(F.col("strike") - F.col("underlying_price")), "strike", "contract_symbol")
    return contracts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n").where("implied_volatility is not null")


def signal(pcr: Column, unusual: Column) -> Column:
    bullish = F.when(unusual, "strong_bullish").otherwise("bullish")
    return F.when(pcr.isNull(), "neutral").when(pcr >= STRONG, "strong_bullish").when(pcr >= BULL, bullish).when(pcr <= BEAR, "bearish").otherwise("neutral")


def snapshots(contracts: DataFrame, today: str, days: tuple[int, int] = DAYS) -> DataFrame:
    """One row per ticker; error no_valid_expirations where no expiration is in the window, no_price without a price."""
    live = in_window(contracts, today, days)
    total = lambda side, c: F.coalesce(F.sum(F.when(F.col("option_type") == side, F.coalesce(F.col(c), F.lit(0)))), F.lit(0)).cast("long")
    sums = live.groupBy("ticker").agg(
        F.count_distinct("expiration").alias("expirations_used"), total("put", "volume").alias("put_volume"), total("call", "volume").alias("call_volume"),
        total("put", "open_interest").alias("put_oi"), total("call", "open_interest").alias("call_oi"),
    )
    iv = lambda side: F.avg(F.when(F.col("option_type") == side, F.col("implied_volatility")))
    ivs = atm_contracts(live).groupBy("ticker").agg(iv("put").alias("avg_put_iv"), iv("call").alias("avg_call_iv"))
    out = contracts.groupBy("ticker").agg(F.max("underlying_price").alias("price")).join(sums, "ticker", "left").join(ivs, "ticker", "left")
    pcr = lambda p, c: F.when(F.col(c) > 0, F.col(p).cast("double") / F.col(c))
    unusual = F.coalesce((F.col("put_oi") > 0) & (F.col("put_volume") > UNUSUAL * F.col("put_oi")), F.lit(False))
    out = out.withColumns({"pcr_volume": pcr("put_volume", "call_volume"), "pcr_oi": pcr("put_oi", "call_oi"), "unusual_activity": unusual})
    out = out.withColumn("error", F.when(F.col("price").isNull(), "no_price").when(F.col("expirations_used").isNull(), "no_valid_expirations"))
    return out.withColumn("signal", signal(F.col("pcr_volume"), F.col("unusual_activity"))).fillna(0, ["put_volume", "call_volume", "put_oi", "call_oi", "expirations_used"])


def answers(payloads: DataFrame) -> DataFrame:
    """payloads (ticker, body: JSON, error) read once: ticker, price, expirations, chains, error. A ticker's answer may
    come in pages, one row each, so no row has to hold all of its contracts.

    error: no_price, no_options, the first characters of what the fetch said, or null. A chain that could not be fetched
    is null or not there and is passed over; the rest of its ticker counts.
    """
    a = payloads.select("ticker", F.from_json("body", CHAINS).alias("a"), F.substring("error", 1, ERROR_CHARS).alias("_said"))
    price = F.when(F.col("a.price") != 0, F.col("a.price"))
    error = F.when(F.col("_said").isNotNull(), F.col("_said")).when(price.isNull(), "no_price").when(F.coalesce(F.size("a.expirations"), F.lit(0)) <= 0, "no_options")
    return a.select("ticker", price.alias("price"), F.col("a.expirations").alias("expirations"), F.col("a.chains").alias("chains"), error.alias("error"))


def contracts_of(read: DataFrame) -> DataFrame:
    """answers() without error to one row per contract, as the archive holds them."""
    chain = read.where("error is null").select("ticker", "price", F.explode("chains").alias("c")).where("c.expiration is not null")
    side = lambda s: F.transform(F.coalesce(f"c.{s}s", F.array()), lambda o: F.struct(F.lit(s).alias("option_type"), o.alias("o")))
    both = chain.select("ticker", "price", F.col("c.expiration").alias("expiration"), F.explode(F.concat(side("call"), side("put"))).alias("x")).select("*", "x.*")
    return both.select(
        "ticker", "expiration", "option_type", "o.strike", F.col("o.lastPrice").alias("last_price"), "o.bid", "o.ask", F.col("o.volume").cast("long").alias("volume"),
        F.col("o.openInterest").cast("long").alias("open_interest"), F.col("o.impliedVolatility").alias("implied_volatility"), F.col("o.inTheMoney").alias("in_the_money"),
        F.col("o.contractSymbol").alias("contract_symbol"), F.try_to_timestamp("o.lastTradeDate").alias("last_trade_date"), F.col("price").alias("underlying_price"),
    )


def scan(payloads: DataFrame, today: str, days: tuple[int, int] = DAYS) -> tuple[DataFrame, DataFrame]:
    """(one row for each ticker as in snapshots(), with every kind of error; contracts inside the days) of raw payloads.

    The payloads are parsed once, into a table of the cluster's shared folder that the report and the contracts read.
    A page with an error is passed over; only a ticker of which every page has one has an error, the least of them.
    """
    path = files.work_path(payloads.sparkSession, "answers")
    answers(payloads).write.parquet(path)
    read = payloads.sparkSession.read.parquet(path)
    live = in_window(contracts_of(read), today, days)
    found = snapshots(live, today, days).drop("price", "error", "expirations_used")
    each = read.select("ticker", "price", "error", F.explode_outer("expirations").alias("e"))
    inside = F.datediff(F.try_to_date("e"), F.lit(today).cast("date")).between(*days)
    out = each.groupBy("ticker").agg(F.max("price").alias("price"), F.count_distinct(F.when(inside, F.col("e"))).alias("expirations_used"), F.bool_or(F.col("error").isNull()).alias("_ok"), F.min("error").alias("error"))
    error = F.when(~F.col("_ok"), F.col("error")).when(F.col("expirations_used") == 0, "no_valid_expirations")
    out = out.select("ticker", "price", F.col("expirations_used").cast("int").alias("expirations_used"), error.alias("error"))
    out = out.join(found, "ticker", "left").fillna(0, ["put_volume", "call_volume", "put_oi", "call_oi"]).fillna({"unusual_activity": False, "signal": "neutral"})
    return out.withColumn("price", F.coalesce("price", F.lit(0.0))), live


def scan_summary(snaps: DataFrame) -> DataFrame:
    """One row: tickers with a result, without options, and with another error."""
    return snaps.agg(F.count_if(F.col("error").isNull()).alias("valid"), F.count_if(F.col("error") == "no_options").alias("no_options"), F.count_if(F.col("error") != "no_options").alias("errors"))


def report(snaps: DataFrame, by: str = "pcr_volume", n: int = 30, min_pcr: float = 0.0, only: str | None = None) -> DataFrame:
    """The top n by a measure; null counts as zero."""
    if by not in ("pcr_volume", "pcr_oi", "put_volume"):
        raise ValueError(f"cannot sort by {by}")
    out = snaps.where("error is null and pcr_volume is not null")
    if min_pcr > 0:
        out = out.where(F.col("pcr_volume") >= min_pcr)
    if only:
        out = out.where(F.col("signal") == only)
    return out.orderBy(F.coalesce(F.col(by), F.lit(0)).desc(), "ticker").limit(n)


def bullish(snaps: DataFrame, min_pcr: float = 1.0) -> DataFrame:
    return snaps.where("error is null").where(F.col("signal").isin("bullish", "strong_bullish")).where(F.coalesce("pcr_volume", F.lit(0.0)) >= min_pcr)


def sentiment(snaps: DataFrame) -> DataFrame:
    """(signal, n, n_unusual) over tickers without error."""
    return snaps.where("error is null").groupBy("signal").agg(F.count("*").alias("n"), F.count_if("unusual_activity").alias("n_unusual"))


