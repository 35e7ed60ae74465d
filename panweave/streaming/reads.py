"""Mapping reads as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_fasta(spark: SparkSession, folder: str, *, files_at_once: int = 100) -> DataFrame:
    """read_id and seq of FASTA files that appear in a folder."""
    lines = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_at_once).text(folder)
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>|\r$", "")
    body = F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)")
    return lines.filter("trim(value) <> ''").select(head.alias("read_id"), F.upper(F.regexp_replace(body, "[\\r\\n]", "")).alias("seq"))


def map_stream(reads: DataFrame, mapper: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Writes ``mapper`` of each batch of reads as Parquet under ``out``, a folder for each batch.

    Reads don't depend on each other, so there is no state. A batch that is run again overwrites its own folder."""

    def batch(rows: DataFrame, number: int) -> None:
        mapper(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
