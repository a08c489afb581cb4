"""Queries over landed data: archives with pruned reads, CSV, HTML and JSON sources, upserts of late days, scans, ingests.

Their inputs are built from the star-schema tables, so that each has a twin in SQL. What has to lie in files first goes to
the folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.functions.numeric import half_even
from marketlake.operators import bars as ops
from marketlake.operators import fundamentals as fu
from marketlake.operators import ingest, insider, news, options, regime
from marketlake.operators import membership as mem
from marketlake.plans import history, sql
from marketlake.plans.market import _CLEAN, rounded
from marketlake.sources import archive, files
from marketlake.sources.tables import bars, daily_bars, market_series, nation_bars, read, tasks, trades
from marketlake.streaming.archives import merge_days

#: Tasks' worth of contracts for each page of an expiration.
PAGE_TASKS = 12


def late_days_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into a table by month: the second re-sends two tickers, twice, and leaves the others' bars alone."""
    b = daily_bars(trades(spark, sf_dir).withColumn("date", F.to_date(F.trunc("date", "MM"))))
    path = files.work_path(spark, "bars")
    again = b.where(F.col("ticker").isin("AF", "NO")).withColumn("volume", F.col("volume") * 2)
    for n, batch in enumerate((b, again, again.unionByName(again.withColumn("volume", F.lit(0.0))))):
        merge_days(batch, path, f"{path}-merged-{n}")
    return spark.read.schema(b.schema).parquet(path).groupBy("ticker").agg(F.count("*").alias("n"), half_even(F.sum("volume"), 3).alias("volume"), F.count_distinct("date").alias("months"))


def _archived(spark: SparkSession, sf_dir: str) -> str:
    e = read(spark, sf_dir, "events")
    path = files.work_path(spark, "archive")
    e.withColumn("snapshot_date", F.to_date("ts")).write.partitionBy("snapshot_date").parquet(path)
    return path


def archive_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read of days from an archive, pruned by partition, around the middle of what is there."""
    path = _archived(spark, sf_dir)
    found = archive.archive_summary(spark, path).select(F.date_add("first_day", 3).cast("string"), F.date_sub("last_day", 3).cast("string")).first()
    return archive.load_archive(spark, path, *found).groupBy("event_type").agg(F.count("*").alias("n"), F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day"))


def archive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_summary(spark, _archived(spark, sf_dir)).select("days", "first_day", "last_day")


def members_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership out to one CSV and back."""
    path = files.work_path(spark, "members")
    files.write_csv(history._orders_as_members(spark, sf_dir), path, "ticker", "date_added", "date_removed")
    return files.read_csv(spark, path, files.MEMBERS).groupBy("ticker").agg(F.count("*").alias("n"), F.count("date_removed").alias("n_left"), F.min("date_added").alias("first_day"))


def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table of nations for each region, scraped for the column that holds tickers."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td> <a href='x'>"), F.col("n_name"), F.lit(".AS</a></td></tr>"))
    pages = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy(F.col("r_name").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    html = F.concat(F.lit("<p>x</p><table><tr><th>Key</th></tr></table><table><tr><th>Key</th><th>Ticker</th></tr>"), F.col("rows"), F.lit("</table>"))
    cells = files.html_column(pages.select("page", html.alias("html")), "Ticker")
    return mem.scraped_tickers(cells, "dax40")


def cik_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published map of tickers to numbers, one JSON document for each nation, in the order of the numbers."""
    s = read(spark, sf_dir, "supplier")
    entry = F.struct(F.col("s_suppkey").cast("string").alias("key"), F.struct(F.lower("s_name").alias("ticker"), F.col("s_suppkey").cast("long").alias("cik_str")).alias("value"))
    return fu.cik_map(s.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s_suppkey", entry.alias("e"))))["e"])).alias("body")))


def older_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older index files to fetch, for submissions of which the recent part begins at a customer's first order."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("days"))
    shard = lambda n, to: F.struct(F.format_string(f"{n}-%s.json", F.col("o_custkey").cast("string")).alias("name"), to.alias("filingTo"))
    filings = F.struct(F.struct(F.col("days").alias("filingDate")).alias("recent"), F.array(shard("a", F.lit("1992-06-30")), shard("b", F.col("days")[0]), shard("c", F.lit(None).cast("string"))).alias("files"))
    docs = o.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_json(F.struct(filings.alias("filings"))).alias("body"))
    return insider.older_shards(docs, since="1993-01-01")


def regime_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regime from bars alone, two of whose tickers are the volatility and the index."""
    vix, index = market_series(spark, sf_dir)
    both = vix.select(F.lit("^VIX").alias("ticker"), "date", F.col("vix").alias("close")).unionByName(index.select(F.lit("SPY").alias("ticker"), "date", "close"))
    return regime.detect(both, "1993-01-01", "2010-12-31", universe=nation_bars(spark, sf_dir))


def option_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw chains in JSON to one row for each ticker, with those that have no price, no options or an error. A ticker's
    answer is a page for each expiration, and more of them as the contracts grow, so no document grows with the tables."""
    c = history._contracts(spark, sf_dir)
    contract = F.struct("strike", F.col("volume").cast("double").alias("volume"), F.col("open_interest").cast("double").alias("openInterest"), F.col("implied_volatility").alias("impliedVolatility"), F.col("contract_symbol").alias("contractSymbol"))
    side = lambda s: F.collect_list(F.when(F.col("option_type") == s, contract)).alias(f"{s}s")
    n = tasks(read(spark, sf_dir, "lineitem"))
    page = ["ticker", "underlying_price", "expiration", "page"]
    c = c.withColumn("page", F.pmod(F.xxhash64("contract_symbol"), F.lit(-(-n // PAGE_TASKS)))).repartition(n, *page)
    chains = c.groupBy(*page).agg(side("call"), side("put"))
    body = F.to_json(F.struct(F.col("underlying_price").alias("price"), F.array("expiration").alias("expirations"), F.array(F.struct("expiration", "calls", "puts")).alias("chains")))
    good = chains.select("ticker", body.alias("body"), F.lit(None).cast("string").alias("error"))
    bad = [("~a", '{"expirations": ["1996-06-20"]}', None), ("~b", '{"price": 2.0, "expirations": []}', None), ("~c", None, "x" * 60), ("~d", '{"price": 3.0, "expirations": ["2000-01-01"]}', None), ("~f", '{"price": 5.0, "expirations": ["soon"], "chains": [{"expiration": "soon", "calls": [{"strike": 1.0, "volume": 5.0}], "puts": null}]}', None), ("~e", '{"price": 4.0, "expirations": ["1996-06-20"], "chains": [null]}', None)]
    snaps, _ = options.scan(good.unionByName(spark.createDataFrame(bad, good.schema)), history.TODAY)
    out = snaps.select("ticker", "price", "pcr_volume", "pcr_oi", "put_volume", "call_volume", "put_oi", "call_oi", "avg_put_iv", "avg_call_iv", "unusual_activity", "expirations_used", "signal", "error")
    return rounded(out, "price", "pcr_volume", "pcr_oi", "avg_put_iv", "avg_call_iv", digits=9)


def news_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of fetched news says of itself; one ticker in ten could not be fetched."""
    e = read(spark, sf_dir, "events")
    article = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("headline"), F.unix_timestamp("ts").alias("datetime"))
    docs = e.groupBy("user_id").agg(F.to_json(F.collect_list(article)).alias("body"))
    failed = F.pmod("user_id", F.lit(10)) == 0
    return news.scan(docs.select(F.col("user_id").cast("string").alias("key"), F.when(~failed, F.col("body")).alias("body"), F.when(failed, "HTTP 503").alias("error")))[1]


def fundamentals_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ingest of every customer as a company: counts of each status, rows tried and rows inserted."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    obs = F.struct(F.col("o_totalprice").alias("val"), F.year(day).alias("fy"), F.lit("FY").alias("fp"), F.date_format(day, "yyyy-MM-dd").alias("end"), F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("filed"), F.lit("10-K").alias("form"))
    facts = o.groupBy("o_custkey").agg(F.collect_list(obs).alias("obs"), F.date_format(F.max(F.date_add(day, 30)), "yyyy-MM-dd").alias("last"))
    us_gaap = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("GrossProfit"), F.struct(F.create_map(F.lit("USD"), F.col("obs")).alias("units"))))
    docs = facts.select(F.col("o_custkey").cast("string").alias("ticker"), F.to_json(F.struct(us_gaap.alias("facts"))).alias("body"), "last")
    companies = c.select(F.col("c_custkey").cast("string").alias("ticker"), F.when(F.col("c_nationkey") != 3, F.col("c_custkey").cast("int")).alias("cik"), "c_nationkey")
    fetched = companies.join(docs, "ticker", "left").select("ticker", F.when(F.col("c_nationkey") != 7, F.col("body")).alias("body"), F.when(F.col("c_nationkey") == 7, "HTTP 500").alias("error"))
    even = companies.where("c_nationkey in (8, 10)").select("ticker")
    stored = fu.parse(docs.withColumn("cik", F.lit(1)).join(even, "ticker", "left_semi")).where("fiscal_year <= 1995 or ticker like '%5'")
    offered = docs.select("ticker", F.to_json(F.struct(F.struct(F.struct(F.array("last").alias("filingDate")).alias("recent")).alias("filings"))).alias("body"))
    _, report = fu.ingest(companies.select("ticker", "cik"), stored, offered, fetched, only_new=True)
    return report.groupBy("status").agg(F.count("*").alias("n"), F.sum("attempted").alias("attempted"), F.sum("inserted").alias("inserted"))


def universe_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel of all that were members in a window, by one refresh."""
    b = bars(spark, sf_dir)
    m = [("AF", "1992-01-01", None), ("NO", "1996-01-01", "1996-03-01"), ("RF", "1992-01-01", "1994-12-31"), ("GONE", "1992-01-01", None)]
    members = spark.createDataFrame(m, "ticker string, date_added string, date_removed string").select("ticker", F.to_date("date_added").alias("date_added"), F.to_date("date_removed").alias("date_removed"))
    none = b.where("false")
    renames = spark.createDataFrame([], files.RENAMES)
    r = ingest.load_universe(members, "1995-06-01", "1996-12-31", b, renamed=none, retried=none, renames=renames, path=files.work_path(spark, "refresh"))
    return r.panel.groupBy("ticker").agg(F.count("*").alias("n"), half_even(F.sum("volume"), 3).alias("volume"))


def panel_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached panel and a batch of a few weeks, part of it sent again: new days are added, tickers that the batch alone
    holds take a rename, a retry or the fallback, one rename is blocked by its own new symbol, two tickers stay lost."""
    b = nation_bars(spark, sf_dir).select("ticker", "date", *ops.FIELDS)
    n, recent = F.col("ticker").try_cast("int"), F.col("date") >= F.lit("2001-08-15").cast("date")
    new_name = lambda t, name: b.where(n == t).withColumn("ticker", F.lit(name))
    landed = b.where(recent | n.between(15, 17)).withColumn("volume", F.col("volume") * 2).unionByName(new_name(19, "R19"))
    renames = spark.createDataFrame([("18", "R18", "active"), ("19", "R19", "active"), ("20", "R20", "gone")], files.RENAMES)
    asked = b.select("ticker").distinct().unionByName(spark.createDataFrame([("R19",), ("NONE",)], "ticker string"))
    r = ingest.refresh(
        asked, landed, new_name(18, "R18").unionByName(new_name(19, "R19")), b.where("ticker in ('20', '21')"), renames, files.work_path(spark, "refresh"),
        cached=b.where((n < 15) & (F.col("date") < "2001-08-25")), fallback=b.where("ticker = '22'"), known_unavailable=spark.createDataFrame([("X",)], "ticker string"),
    )
    lost = r.unavailable.select("ticker", F.lit(True).alias("unavailable"))
    served = r.panel.groupBy("ticker").agg(F.count("*").alias("n"), half_even(F.sum("volume"), 3).alias("volume"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return served.join(lost, "ticker", "full_outer").withColumn("unavailable", F.coalesce("unavailable", F.lit(False)))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker's bars, which is what the operator is for."""
    return rounded(ops.of_ticker(bars(spark, sf_dir), "NO").select("date", "open", "high", "low", "close", "volume"), *ops.FIELDS)


QUERIES = {
    f.__name__: f
    for f in (
        late_days_upsert, archive_range, archive_days, members_csv, html_lists, cik_map, older_shards, regime_detect, option_scan, news_scan, fundamentals_ingest,
        universe_load, panel_refresh, point_lookup,
    )
}

_OPTION_COLUMNS = "ticker, price, pcr_volume, pcr_oi, put_volume, call_volume, put_oi, call_oi, avg_put_iv, avg_call_iv, unusual_activity, expirations_used, signal, error"

ORACLES = {
    "late_days_upsert": f"""
WITH {sql.TRADES},
m AS (SELECT ticker, date_trunc('month', date) AS date, sum(volume) AS volume FROM trades GROUP BY ALL)
SELECT ticker, count(*) AS n, round_even(sum(CASE WHEN ticker IN ('AF', 'NO') THEN 2 * volume ELSE volume END), 3) AS volume, count(DISTINCT date) AS months FROM m GROUP BY ticker""",
    "archive_range": """
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events), b AS (SELECT min(day) + 3 AS s, max(day) - 3 AS e FROM e)
SELECT event_type, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM e, b WHERE day BETWEEN b.s AND b.e GROUP BY event_type""",
    "archive_days": "SELECT count(DISTINCT CAST(ts AS DATE)) AS days, min(CAST(ts AS DATE)) AS first_day, max(CAST(ts AS DATE)) AS last_day FROM events",
    "members_csv": """
SELECT 'c' || o_custkey AS ticker, count(*) AS n, count(*) FILTER (WHERE o_orderstatus != 'O') AS n_left, min(CAST(o_orderdate AS DATE)) AS first_day FROM orders GROUP BY o_custkey""",
    "html_lists": "SELECT DISTINCT trim(n_name) || '.DE' AS ticker FROM nation JOIN region ON n_regionkey = r_regionkey WHERE length(trim(n_name)) + 3 <= 15",
    "cik_map": "SELECT upper(s_name) AS ticker, CAST(max(s_suppkey) AS INTEGER) AS cik FROM supplier GROUP BY upper(s_name)",
    "older_shards": """
WITH d AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS oldest FROM orders GROUP BY o_custkey),
f AS (SELECT o_custkey, oldest, unnest(['a', 'b', 'c']) AS k FROM d)
SELECT CAST(o_custkey AS VARCHAR) AS ticker, k || '-' || o_custkey || '.json' AS name FROM f WHERE oldest > DATE '1993-01-01' AND k != 'a'""",
    "regime_detect": history.ORACLES["regime_daily"],
    "option_scan": f"""
SELECT {_OPTION_COLUMNS} FROM ({history.ORACLES["options_snapshot"]})
UNION ALL SELECT '~a', 0.0, NULL, NULL, 0, 0, 0, 0, NULL, NULL, false, 1, 'neutral', 'no_price'
UNION ALL SELECT '~b', 2.0, NULL, NULL, 0, 0, 0, 0, NULL, NULL, false, 0, 'neutral', 'no_options'
UNION ALL SELECT '~c', 0.0, NULL, NULL, 0, 0, 0, 0, NULL, NULL, false, 0, 'neutral', repeat('x', 50)
UNION ALL SELECT '~d', 3.0, NULL, NULL, 0, 0, 0, 0, NULL, NULL, false, 0, 'neutral', 'no_valid_expirations'
UNION ALL SELECT '~f', 5.0, NULL, NULL, 0, 0, 0, 0, NULL, NULL, false, 0, 'neutral', 'no_valid_expirations'
UNION ALL SELECT '~e', 4.0, NULL, NULL, 0, 0, 0, 0, NULL, NULL, false, 1, 'neutral', NULL""",
    "news_scan": """
SELECT count(DISTINCT user_id) AS tickers, count(*) FILTER (WHERE user_id % 10 != 0) AS articles, count(DISTINCT CASE WHEN user_id % 10 = 0 THEN user_id END) AS errors FROM events""",
    "fundamentals_ingest": """
WITH k AS (SELECT o_custkey, year(CAST(o_orderdate AS DATE)) AS fy, min(CAST(o_orderdate AS DATE)) + 30 AS filed FROM orders GROUP BY ALL),
last AS (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) + 30 AS offered FROM orders GROUP BY o_custkey),
stored AS (SELECT k.* FROM k JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (8, 10) AND (fy <= 1995 OR CAST(o_custkey AS VARCHAR) LIKE '%5')),
known AS (SELECT o_custkey, max(filed) AS known FROM stored GROUP BY o_custkey),
s AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'no_cik' WHEN offered <= known THEN 'up_to_date' WHEN c_nationkey = 7 THEN 'error' WHEN offered IS NULL THEN 'no_facts' ELSE 'ok' END AS status
  FROM customer LEFT JOIN last ON c_custkey = last.o_custkey LEFT JOIN known ON c_custkey = known.o_custkey),
a AS (SELECT k.o_custkey, count(*) AS attempted, count(*) FILTER (WHERE stored.fy IS NULL) AS inserted FROM k LEFT JOIN stored ON k.o_custkey = stored.o_custkey AND k.fy = stored.fy GROUP BY k.o_custkey)
SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'ok' THEN attempted WHEN status = 'up_to_date' THEN 0 END) AS BIGINT) AS attempted,
  CAST(sum(CASE WHEN status = 'ok' THEN inserted WHEN status = 'up_to_date' THEN 0 END) AS BIGINT) AS inserted
FROM s LEFT JOIN a ON c_custkey = o_custkey GROUP BY status""",
    "universe_load": f"""
WITH {sql.BARS}, {_CLEAN}
SELECT ticker, count(*) AS n, round_even(sum(volume), 3) AS volume FROM clean WHERE ticker IN ('AF', 'NO') GROUP BY ticker""",
    "panel_refresh": f"""
WITH {sql.TRADES},
b AS (SELECT CAST(s_nationkey AS VARCHAR) AS ticker, s_nationkey AS k, date, first(price ORDER BY {sql.NTH}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {sql.NTH}) AS close,
  sum(volume) AS volume FROM trades JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, date),
p AS (
  SELECT ticker, date, open, high, low, close, CASE WHEN date >= DATE '2001-08-15' THEN 2 * volume ELSE volume END AS volume FROM b WHERE k < 15
  UNION ALL SELECT ticker, date, open, high, low, close, 2 * volume FROM b WHERE k BETWEEN 15 AND 17
  UNION ALL SELECT ticker, date, open, high, low, close, volume FROM b WHERE k IN (18, 20, 21, 22)
  UNION ALL SELECT 'R19', date, open, high, low, close, volume FROM b WHERE k = 19),
bars AS (SELECT * FROM p), {_CLEAN.strip()}
SELECT ticker, count(*) AS n, round_even(sum(volume), 3) AS volume, min(date) AS first_date, max(date) AS last_date, false AS unavailable FROM clean GROUP BY ticker
UNION ALL SELECT ticker, NULL, NULL, NULL, NULL, true FROM (SELECT DISTINCT ticker FROM b WHERE k IN (19, 23, 24) UNION ALL SELECT 'X')""",
    "point_lookup": f"""
WITH {sql.BARS}
SELECT date, round_even(open, 6) AS open, round_even(high, 6) AS high, round_even(low, 6) AS low, round_even(close, 6) AS close, round_even(volume, 6) AS volume FROM bars WHERE ticker = 'NO'""",
}
