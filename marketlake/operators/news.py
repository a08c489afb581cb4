"""News rows: projection of raw articles, and dedup over overlapping fetch windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ARTICLE = "struct<id: bigint, headline: string, summary: string, source: string, url: string, image: string, category: string, related: string, datetime: bigint>"


def articles(payloads: DataFrame) -> DataFrame:
    """payloads (ticker, body: JSON list) to rows; a body that is no list gives none; time 0 is no time."""
    a = payloads.where(F.startswith(F.ltrim("body"), F.lit("["))).select("ticker", F.explode(F.from_json("body", f"array<{ARTICLE}>")).alias("a"))
    at = F.when(F.col("a.datetime") != 0, F.timestamp_seconds("a.datetime"))
    return a.select(
        "ticker", F.col("a.id").alias("article_id"), "a.headline", "a.summary", "a.source", "a.url", F.col("a.image").alias("image_url"), "a.category", "a.related", at.alias("published_at"),
    )


def dedup(rows: DataFrame, order: str = "published_at") -> DataFrame:
    """Of each (ticker, article_id) the copy fetched first; rows without an id all stay.

    Copies of the same day and time are ordered by all their columns, so a rerun keeps the same one. Rows without an id are
    kept out of the window, so they do not gather in one task.
    """
    rest = [F.col(c).asc_nulls_last() for c in sorted(rows.columns) if c not in ("ticker", "article_id", "snapshot_date", order)]
    w = W.partitionBy("ticker", "article_id").orderBy("snapshot_date", F.col(order).asc_nulls_last(), *rest)
    known = rows.where("article_id is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return known.unionByName(rows.where("article_id is null"))


def scan(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, one row: tickers asked, articles found, errors) of fetched documents (key, body, error)."""
    failed = F.col("error").isNotNull() | F.col("body").isNull()
    found = articles(documents.where(~failed).select(F.col("key").alias("ticker"), "body"))
    asked = documents.agg(F.count("*").alias("tickers"), F.count_if(failed).alias("errors"))
    return found, asked.crossJoin(found.agg(F.count("*").alias("articles"))).select("tickers", "articles", "errors")
