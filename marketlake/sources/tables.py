"""Market inputs projected from the star-schema tables: the same shapes that landed market files have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a stored table that a task of a shuffle takes.
TASK_ROWS = 250_000


def tasks(stored: DataFrame) -> int:
    """How many tasks a shuffle of a stored table takes, so that a task's share stays as it is while the table grows; one
    for each core at least. Parquet's footers hold the number of rows, so no column is read."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // TASK_ROWS))


def daily_bars(rows: DataFrame) -> DataFrame:
    """rows (ticker, date, price, volume, nth) to bars: the first and last price by nth, the extremes and the volume."""
    return rows.groupBy("ticker", "date").agg(
        F.min_by("price", "nth").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "nth").alias("close"), F.sum("volume").alias("volume"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"), nth.alias("nth"), "l_suppkey", "l_discount",
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(trades(spark, sf_dir))


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticker for each supplier nation: a wider panel, for breadth."""
    of = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("nation"))
    return daily_bars(trades(spark, sf_dir).join(of, "l_suppkey").withColumn("ticker", F.col("nation")))


def market_series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(date, vix) and (date, close): a volatility and an index series."""
    t = trades(spark, sf_dir).groupBy("date").agg((F.avg("l_discount") * 500 + 0.0).alias("vix"), F.avg("price").alias("close"))
    return t.select("date", "vix"), t.select("date", "close")
