"""Archives as streams: late re-fetches dropped by event time, rows filed by day, incremental bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlake.operators import bars as ops
from marketlake.sources.files import exists, remove


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def dedup_stream(rows: DataFrame, late: str = "4 days") -> DataFrame:
    """The first copy of each (ticker, article_id) inside the lateness; rows without an id pass by the state."""
    marked = rows.withWatermark("published_at", late)
    known = marked.where("article_id is not null").dropDuplicatesWithinWatermark(["ticker", "article_id"])
    return known.unionByName(marked.where("article_id is null"))


def daily_counts(rows: DataFrame, late: str = "4 days") -> DataFrame:
    """Articles by ticker and day of publication, each day given out once it is over by the watermark."""
    return rows.withWatermark("published_at", late).groupBy(F.window("published_at", "1 day").alias("day"), "ticker").agg(F.count("*").alias("n"))


def file_by_day(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a daily archive, all that is there now."""
    stamped = rows.withColumn("snapshot_date", F.to_date("published_at"))
    return stamped.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("snapshot_date").trigger(availableNow=True).start()


def merge_days(batch: DataFrame, path: str, staged: str, newest: str | None = None) -> None:
    """Upsert bars by (ticker, date) into a table partitioned by date; only the days of the batch are read and written.

    Of bars that share ticker and date in the batch the one with the greatest `newest` counts, else the greatest by all
    its fields. The merged days are first written to `staged` and kept there until the table has them: if a run ends
    while days are being replaced, the next one finishes from that copy, and loses no other ticker's bars.
    """
    spark = batch.sparkSession
    if not exists(spark, f"{staged}/_SUCCESS"):
        new = ops.one_per_day(batch, newest)
        if exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path)
            new = ops.upsert(old.join(new.select("date").distinct(), "date", "left_semi"), new)
        new.write.mode("overwrite").parquet(staged)
    merged = spark.read.schema(batch.schema).parquet(staged)
    merged.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def upsert_bars(bars: DataFrame, path: str, checkpoint: str, newest: str | None = None) -> StreamingQuery:
    """Each batch of bars replaces those of the same ticker and date and leaves all others; a replayed batch changes nothing."""

    def replace(batch: DataFrame, n: int) -> None:
        if n:
            remove(batch.sparkSession, f"{checkpoint}/merged/{n - 1}")
        merge_days(batch, path, f"{checkpoint}/merged/{n}", newest)

    return bars.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
