"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

T = TypeVar("T")

#: Folders used in place of spark.checkpoint.dir where the session names none, by application.
_OWN_DIRS: dict[str, str] = {}
#: Tables in shared folders that have not been dropped.
_WRITTEN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Only a local master gets a folder of our own without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="marketlake-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def write_shared(df: DataFrame, label: str, compression: str = "zstd", group_rows: int | None = None) -> str:
    """Write a table to the shared folder, which also cuts its lineage; returns the path.

    Rows of megabytes need `group_rows`: Spark reads 4096 rows at once, and the rows of a Parquet row group (128 MB) at most.
    """
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    if group_rows:
        out = out.option("parquet.block.row.count.limit", group_rows)
    out.parquet(path)
    _WRITTEN.append(path)
    return path


def drop_shared(spark: SparkSession, path: str) -> None:
    """Delete a table of write_shared() that no result reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _WRITTEN:
        _WRITTEN.remove(path)


def keep_shared(*paths: str) -> None:
    """These tables are results in their own right: scratch() leaves them."""
    for path in paths:
        if path in _WRITTEN:
            _WRITTEN.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables of write_shared() made inside are dropped at the end, but for the paths put into the list that it gives.

    An operator's result reads such tables when it is asked for its rows, so use this around a step that writes them out.
    """
    before, kept = set(_WRITTEN), []
    try:
        yield kept
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            drop_shared(spark, path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name` that differs by row. Written once: numbers given anew by each evaluation of a plan
    could land on other rows, where a source or a repeated shuffle hands them over in another order."""
    return docs.sparkSession.read.parquet(write_shared(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(uid, id0, no_id, doc_id, text): a key from the row itself, the same however often a plan is evaluated.

    Rows share the key (uid, id0, no_id) where they are equal in doc_id and text; nth() tells these apart.
    """
    doc_id, text = F.col(doc_id).cast("long"), F.col(text)
    return docs.select(F.xxhash64(doc_id, text).alias("uid"), F.coalesce(doc_id, F.lit(0)).alias("id0"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), text.alias("text"))


KEY = ["uid", "id0", "no_id"]


def nth(rows: DataFrame) -> DataFrame:
    """rows with `nth`, 1 for one of the rows that share a key of keyed(), and 2 on for the others."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*KEY).orderBy("doc_id")))


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now, not at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores until no column has it (column names match in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def per_worker(key: tuple, make: Callable[[], T]) -> T:
    """make(), once in each Python worker process: tasks that follow in the same process find it again."""
    cache = sys.modules.setdefault("_marketlake_per_worker", types.ModuleType("_marketlake_per_worker")).__dict__
    if key not in cache:
        cache[key] = make()
    return cache[key]


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim() -> None:
    """Hand freed memory back, so that a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose text column holds about `most` bytes; one longer text makes a batch alone."""
    try:
        yield from _pieces(batches, column, most)
    finally:
        trim()


def _pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = batch.column(batch.schema.get_field_index(column)).to_pylist() if batch.num_rows == 1 else None
        if lengths is not None or batch.num_rows == 0:
            if batch.num_rows:
                yield batch
            continue
        import pyarrow.compute as pc

        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        begin = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += int(n)
        yield batch.slice(begin)


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null gives b''."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()
    return [v or b"" for v in values]
