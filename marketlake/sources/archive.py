"""Daily archives: one partition per snapshot_date, a rerun replaces its own day, reads prune by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_snapshot(rows: DataFrame, path: str, day: str) -> bool:
    """Write a day's rows, replacing that day only; nothing is written for no rows."""
    if rows.isEmpty():
        return False
    stamped = rows.withColumn("snapshot_date", F.lit(day).cast("date"))
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)
    return True


def save_scan(scanned: DataFrame, path: str, day: str | None = None) -> bool:
    """A scan's rows (contracts or articles) as the snapshot of a day, today by the session's clock if none is named."""
    return save_snapshot(scanned, path, day or scanned.sparkSession.sql("select cast(current_date() as string)").first()[0])


def load_archive(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the days in [start, end]; columns that some days lack are null there."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if start:
        rows = rows.where(F.col("snapshot_date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("snapshot_date") <= F.lit(end).cast("date"))
    return rows


def archive_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row: days, first and last day, megabytes."""
    files = spark.read.parquet(path).select("snapshot_date", "_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.count_distinct("snapshot_date").alias("days"), F.min("snapshot_date").alias("first_day"), F.max("snapshot_date").alias("last_day"), (F.sum("file_size") / 1048576).alias("mb"))
