"""Strains and reads from Parquet tables of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panweave.operators.sequences import mutated, reads_of, strains_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table below so many bytes for each core is read by few tasks, though it may be much work.
SPREAD = 4 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows``, dealt to all cores if the files are so small that only a few would read them. Large tables stay as
    they are read: splitting files is cheaper than a shuffle."""
    context = rows.sparkSession.sparkContext
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(context.defaultParallelism) if size < SPREAD * context.defaultParallelism else rows


def strains(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Every document with at least k bases."""
    return strains_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k)


def reads(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    """The passages of ``benchmark`` as reads."""
    return reads_of(table(spark, sf_dir, "benchmark"), length)


def changed_reads(spark: SparkSession, sf_dir: str, length: int) -> DataFrame:
    return mutated(reads(spark, sf_dir, length))
