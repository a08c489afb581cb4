"""Warehouse tables, created where they are missing, and small JSON manifests beside cached data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "companies": "ticker string, cik int, title string, updated_at timestamp",
    "index_membership": "index_name string, ticker string, date_added date, date_removed date, source string, loaded_at timestamp",
    "fundamentals": (
        "ticker string, cik int, metric string, source_tag string, value double, unit string, fiscal_year int, fiscal_period string, period_start date,"
        " period_end date, filed_date date, form_type string, inserted_at timestamp"
    ),
    "insider_transactions": (
        "ticker string, cik int, accession_number string, filing_date string, insider_name string, insider_title string, is_director boolean, is_officer boolean,"
        " is_ten_pct_owner boolean, transaction_date string, transaction_code string, shares double, price_per_share double, shares_owned_after double,"
        " ownership_type string, transaction_index int"
    ),
}

#: Tables laid out in buckets by the key that joins use.
BUCKETED = {"fundamentals": "ticker, metric, fiscal_year, fiscal_period, form_type", "insider_transactions": "accession_number"}


def create_tables(spark: SparkSession, database: str = "default", buckets: int = 64) -> None:
    """Idempotent. Metric, unit, form and tag stay strings: Parquet's dictionaries do what lookup tables would. Fact tables
    are bucketed and sorted by their key: take a number of buckets that lets one fit a task."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in TABLES.items():
        key = BUCKETED.get(name)
        layout = f" CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS" if key else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet{layout}")


def current_members(members: DataFrame, index: str) -> DataFrame:
    return members.where((F.col("index_name") == index) & F.col("date_removed").isNull()).select("ticker").distinct()


def write_manifest(spark: SparkSession, path: str, **facts: str | int | float | list[str]) -> None:
    """One JSON row that says what a cache holds; saved_at is stamped."""
    row = {k: [str(x) for x in v] if isinstance(v, list) else v for k, v in facts.items()}
    df = spark.createDataFrame([row], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    df.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest, or None where there is none."""
    try:
        return spark.read.json(path).first().asDict()
    except Exception as gone:
        if "PATH_NOT_FOUND" not in str(gone):
            raise
        return None


def age_hours(spark: SparkSession, manifest: dict | None) -> float | None:
    if manifest is None:
        return None
    return spark.range(1).select((F.unix_micros(F.current_timestamp()) - F.unix_micros(F.lit(manifest["saved_at"]).cast("timestamp"))) / 3.6e9).first()[0]


def is_stale(age: float | None, most_hours: float = 24.0) -> bool:
    return age is None or age > most_hours
