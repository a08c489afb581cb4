"""Queries over what a refresh keeps between runs: histories as CSV, renames, what is left to fetch, sectors with an age,
daily snapshots, manifests, dimensions that grow. Inputs are built from the star-schema tables, so each has a twin in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.operators import bars as ops
from marketlake.operators import fundamentals as fu
from marketlake.operators import ingest, lookup
from marketlake.plans import history, sql
from marketlake.plans.market import rounded
from marketlake.sources import archive, files, warehouse
from marketlake.sources.tables import bars, nation_bars, read

NOW = "2001-01-10 00:00:00"


def csv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily histories as fetched, a CSV body for each nation; those of every fifth nation are error pages and give none."""
    b = nation_bars(spark, sf_dir)
    line = F.concat_ws(",", F.col("date").cast("string"), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in ops.FIELDS])
    body = F.concat(F.lit("Date,Open,High,Low,Close,Volume\r\n"), F.array_join(F.array_sort(F.collect_list(line)), "\r\n"), F.lit("\r\n"))
    failed = F.col("key").cast("int") % 5 == 0
    documents = b.groupBy(F.col("ticker").alias("key")).agg(body.alias("body")).select("key", F.when(failed, F.lit("<html>No data</html>")).otherwise(F.col("body")).alias("body"))
    found = ingest.csv_bars(documents).groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.max("volume").alias("volume"),
    )
    return rounded(found, "high", "low", "close", "volume")


def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation under a new symbol, those of one region no longer; out to a CSV and back."""
    path = files.work_path(spark, "renames")
    n = read(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("old_ticker"), F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("new_ticker"), F.when(F.col("n_regionkey") != 1, "active").otherwise("gone").alias("status")
    )
    files.write_csv(n, path, "old_ticker")
    return files.read_csv(spark, path, files.RENAMES)


def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run still asks for: not there yet, and not known to be unavailable unless a rename may bring it."""
    asked = nation_bars(spark, sf_dir).select("ticker")
    key = F.col("ticker").cast("int")
    return ops.to_fetch(asked, asked.where(key < 8).distinct(), asked.where(key >= 14).distinct(), _renames(spark, sf_dir))


def renamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that came under new symbols, keyed by the old ones, where the rename is active."""
    b = nation_bars(spark, sf_dir)
    found = ops.under_old_names(b.withColumn("ticker", F.concat(F.lit("R"), "ticker")), _renames(spark, sf_dir))
    return rounded(found.groupBy("ticker").agg(F.count("*").alias("n"), F.max("close").alias("close")), "close")


def newer_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars after what is known of each ticker; one ticker is not known at all."""
    b = bars(spark, sf_dir)
    known = b.where((F.col("ticker") != "NO") & (F.dayofmonth("date") <= 15) & (F.col("date") < "1995-01-01"))
    return ops.newer(b, known).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


def bars_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of a zone turned to UTC, counted by day: late hours change their day."""
    e = read(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("date"))
    return ops.in_utc(e, "+05:30").groupBy("event_type", F.to_date("date").alias("day")).agg(F.count("*").alias("n"), F.min(F.hour("date") * 60 + F.minute("date")).cast("int").alias("first_minute"))


def sector_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sector cache after a run that asks for stale and missing tickers only, some in vain."""
    n = read(spark, sf_dir, "nation").withColumn("ticker", F.col("n_nationkey").cast("string"))
    asked = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("ticker"))
    at = F.timestamp_add("HOUR", -F.col("n_nationkey").cast("int"), F.lit(NOW).cast("timestamp"))
    cache = n.where("n_regionkey != 2").select("ticker", F.col("n_name").alias("sector"), (F.col("n_regionkey") * 1.5).alias("market_cap"), at.alias("fetched_at"))
    wanted = lookup.stale_or_missing(asked, cache, NOW, 12.0)
    key = F.col("n_nationkey")
    fetched = n.join(wanted, "ticker", "left_semi").select("ticker", F.when(key % 5 == 0, "").otherwise(F.lower("n_name")).alias("sector"), (key * 2.0).alias("market_cap"), (key % 4 != 0).alias("ok"))
    out = lookup.refresh_sectors(asked, cache, fetched, NOW)
    return out.select("ticker", "sector", "market_cap", (F.col("fetched_at") == F.lit(NOW).cast("timestamp")).alias("fresh"))


def daily_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans saved by day: a rerun replaces its own day, a day of no rows is none, a column that came later is null before."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    path = files.work_path(spark, "snapshots")
    archive.save_snapshot(e, path, "2001-01-01")
    archive.save_snapshot(e.unionByName(e), path, "2001-01-02")
    archive.save_snapshot(e.withColumn("score", F.col("user_id") * 2), path, "2001-01-02")
    archive.save_snapshot(e.where("false"), path, "2001-01-03")
    return archive.load_archive(spark, path).groupBy("snapshot_date", "event_type").agg(F.count("*").alias("n"), F.count("score").alias("n_score"), F.sum("user_id").cast("long").alias("users"))


def cache_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of the panel says of itself, read back; a cache written now is not stale."""
    path = files.work_path(spark, "manifest")
    facts = ops.panel_summary(bars(spark, sf_dir)).first()
    warehouse.write_manifest(spark, path, trading_days=facts["trading_days"], tickers=facts["tickers"], first_date=str(facts["first_date"]), last_date=str(facts["last_date"]))
    known = warehouse.read_manifest(spark, path)
    stale = warehouse.is_stale(warehouse.age_hours(spark, known)) or not warehouse.is_stale(warehouse.age_hours(spark, warehouse.read_manifest(spark, f"{path}-none")))
    return spark.read.json(path).select("trading_days", "tickers", "first_date", "last_date", F.lit(stale).alias("stale"))


def dimension_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dimension of names that grows by those of a batch; ids that were given stay."""
    known = read(spark, sf_dir, "nation").where("n_nationkey < 10").select((F.col("n_nationkey") + 1).cast("long").alias("id"), F.col("n_name").alias("name"))
    return fu.with_ids(read(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), known, "name").select(F.col("id").cast("long").alias("id"), "name")


def current_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of one index that have not left; two indexes hold the same tickers."""
    m = history._orders_as_members(spark, sf_dir)
    both = m.withColumn("index_name", F.lit("a")).unionByName(m.withColumn("index_name", F.lit("b")).withColumn("date_removed", F.lit(None).cast("date")))
    return warehouse.current_members(both, "a")


QUERIES = {
    f.__name__: f
    for f in (csv_history, fetch_plan, renamed_bars, newer_bars, bars_utc, sector_refresh, daily_snapshots, cache_manifest, dimension_ids, current_members)
}

_NATION = f"""WITH {sql.TRADES},
b AS (SELECT CAST(s_nationkey AS VARCHAR) AS ticker, s_nationkey AS k, date, max(price) AS high, min(price) AS low, last(price ORDER BY {sql.NTH}) AS close,
  sum(volume) AS volume FROM trades JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, date)"""

ORACLES = {
    "csv_history": f"""{_NATION}
SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date, round_even(max(high), 6) AS high, round_even(min(low), 6) AS low,
  round_even(arg_max(close, date), 6) AS close, round_even(max(volume), 6) AS volume FROM b WHERE k % 5 <> 0 GROUP BY ticker""",
    "fetch_plan": f"""{_NATION}
SELECT DISTINCT ticker FROM b JOIN nation ON k = n_nationkey WHERE k >= 8 AND (k < 14 OR n_regionkey <> 1)""",
    "renamed_bars": f"""{_NATION}
SELECT ticker, count(*) AS n, round_even(max(close), 6) AS close FROM b JOIN nation ON k = n_nationkey WHERE n_regionkey <> 1 GROUP BY ticker""",
    "newer_bars": f"""WITH {sql.BARS},
known AS (SELECT ticker, max(date) AS last FROM bars WHERE ticker <> 'NO' AND day(date) <= 15 AND date < DATE '1995-01-01' GROUP BY ticker)
SELECT ticker, count(*) AS n, min(date) AS first_date FROM bars LEFT JOIN known USING (ticker) WHERE last IS NULL OR date > last GROUP BY ticker""",
    "bars_utc": """
WITH e AS (SELECT event_type, CAST(ts AS TIMESTAMP) - INTERVAL 330 MINUTE AS utc FROM events)
SELECT event_type, CAST(utc AS DATE) AS day, count(*) AS n, CAST(min(hour(utc) * 60 + minute(utc)) AS INTEGER) AS first_minute FROM e GROUP BY ALL""",
    "sector_refresh": """
WITH asked AS (SELECT DISTINCT s_nationkey AS k FROM supplier),
n AS (SELECT n_nationkey AS k, n_name, n_regionkey <> 2 AS cached, n_regionkey * 1.5::DOUBLE AS cap, n_nationkey IN (SELECT k FROM asked) AND (n_regionkey = 2 OR n_nationkey > 12) AS fetched FROM nation)
SELECT CAST(k AS VARCHAR) AS ticker, n_name AS sector, cap AS market_cap, k = 0 AS fresh FROM n WHERE cached AND NOT fetched
UNION ALL SELECT CAST(k AS VARCHAR), CASE WHEN k % 4 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'Unknown' ELSE lower(n_name) END WHEN cached THEN n_name ELSE 'Unknown' END,
  CASE WHEN k % 4 <> 0 THEN k * 2.0::DOUBLE WHEN cached THEN cap END, true FROM n WHERE fetched""",
    "daily_snapshots": """
WITH d AS (SELECT DATE '2001-01-01' AS snapshot_date, false AS scored UNION ALL SELECT DATE '2001-01-02', true)
SELECT snapshot_date, event_type, count(*) AS n, count(*) FILTER (WHERE scored AND user_id IS NOT NULL) AS n_score, CAST(sum(user_id) AS BIGINT) AS users FROM events, d GROUP BY ALL""",
    "cache_manifest": f"""WITH {sql.BARS}
SELECT count(DISTINCT date) AS trading_days, count(DISTINCT ticker) AS tickers, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, false AS stale FROM bars""",
    "dimension_ids": """
SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey < 10
UNION ALL SELECT 10 + row_number() OVER (ORDER BY n_name), n_name FROM nation WHERE n_nationkey >= 10""",
    "current_members": "SELECT DISTINCT 'c' || o_custkey AS ticker FROM orders WHERE o_orderstatus = 'O'",
}
