"""Landed files: bars, renames, membership, JSON and XML documents, HTML tables; JDBC where a database holds them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "ticker string, date date, open double, high double, low double, close double, adj_close double, volume double"
RENAMES = "old_ticker string, new_ticker string, status string"
MEMBERS = "ticker string, date_added date, date_removed date"
SNAPSHOTS = "date date, tickers string"
CHANGES = "date date, add string, remove string"


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _at(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    files, where = _at(spark, path)
    files.delete(where, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares: spark.checkpoint.dir; only a local master may do without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="marketlake-")
    return f"{where}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): one row per file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def write_csv(df: DataFrame, path: str, *order: str) -> None:
    """One sorted CSV with a header; an empty table is an error, not an empty file."""
    if df.isEmpty():
        raise RuntimeError("nothing to export")
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def read_jdbc_parts(spark: SparkSession, url: str, table: str, column: str, partitions: int = 8, **options: str) -> DataFrame:
    """A table read in ranges of a column (a number, day or time), whose bounds the database is asked for first. Filters on
    the result go to the database; rows without the column come with the first range."""
    name = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    low, high = read_jdbc(spark, url, f"SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}", **options).first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if low is not None and low != high:
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, partitions: int = 8, batch: int = 10_000, mode: str = "append", **options: str) -> None:
    """Rows into a table, in batches, by as many connections at most as partitions. A task that is tried again writes its
    rows again, so a table without a key takes them through a staging table."""
    df.coalesce(partitions).write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.open: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def _close_cell(self) -> None:
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close_cell()
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self._close_cell()
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self._close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "table" and self.open:
            self._close_cell()
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def html_column(pages: DataFrame, column: str, table: int | None = None) -> DataFrame:
    """(page, cell): a column of the numbered table of each page (page, html), or of the first that has the column."""

    def scan(batches: Iterator):
        import pandas as pd

        for batch in batches:
            out = []
            for page, html in zip(batch["page"], batch["html"], strict=True):
                parser = _Tables()
                parser.feed(html or "")
                found = [t for t in parser.tables if t and column in t[0]] if table is None else parser.tables[table : table + 1]
                for rows in found[:1]:
                    if column not in rows[0]:
                        continue
                    at = rows[0].index(column)
                    out += [(page, r[at]) for r in rows[1:] if len(r) > at and r[at] != ""]
            yield pd.DataFrame(out, columns=["page", "cell"])

    return pages.select(F.col("page").cast("string").alias("page"), "html").mapInPandas(scan, "page string, cell string")
