"""The corpus pipeline: language, near copies, benchmark passages, the mix, token files. run() applies STAGES in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages it is written as Parquet to the folder
that the cluster shares and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm import decontaminate, language, mixing, simhash, tokenbin
from marketlake.llm.common import drop_shared, keep_shared, scratch, shared_dir, table, write_shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language, or of doubtful language, go."""
    return language.keep_known(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more) stays: that of the smallest doc_id."""
    return simhash.keep_distinct(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; n_chars follows."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them, repeats included."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written, stay, and are read back: doc_id, start, n_tokens, ids_crc32."""
    files = tokenbin.write_tokens(docs)
    keep_shared(*files)
    said = spark.range(1).select(F.lit(files[0]).alias("blocks"), F.lit(files[1]).alias("model"), F.current_timestamp().alias("written_at"))
    said.coalesce(1).write.mode("append").parquet(f"{shared_dir(spark)}/token-files")
    return tokenbin.read_tokens(spark, files)


def token_files(spark: SparkSession) -> tuple[str, str]:
    """The paths of the last token files written, for tokenbin.read_tokens()."""
    said = spark.read.parquet(f"{shared_dir(spark)}/token-files")
    return tuple(said.orderBy(F.desc("written_at")).select("blocks", "model").first())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_output", token_output),
]

#: The language stage is a trained network, so SQL cannot express the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as stay:  # what a stage wrote on its way goes with it
            path = write_shared(stage(spark, docs, sf_dir), name)
            stay.append(path)
        if last:
            drop_shared(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
