"""Helpers that several operators share: reading tables, cutting lineage, passing rows through Python."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table below so many bytes for each core is read by few tasks, though it may be much work.
SPREAD = 4 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """A small table dealt to all cores; large files are split by the reader."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < SPREAD * cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text."""
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the session's ``spark.checkpoint.dir``. Only where that is unset and everything
    runs in one process (tests) a temporary folder is chosen."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="panweave-"))
    return sc.getCheckpointDir()


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession, keep: tuple[str, ...] = ()) -> Iterator[None]:
    """Tables that stored() and cut() write meanwhile are deleted at the end, but those whose names begin with one of
    ``keep``. What is left must not depend on them."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            if path.rpartition("/")[2].startswith(keep):
                continue
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder that all machines share, and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` and continue from there: what was lost with an executor is read again, not made again."""
    return stored(df, "cut")


def stored_rows(df: DataFrame, name: str) -> DataFrame:
    """The same for columns of any names, which a Parquet file might not hold together."""
    return stored(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), name).toDF(*df.columns)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def column(df: DataFrame, name: str):
    """The column of exactly this name, which may hold dots or differ from another one only by case."""
    return df["`" + name.replace("`", "``") + "`"]


def doc_rank(doc_id):
    """An id to order and join documents by: null goes below all ids."""
    return F.coalesce(doc_id.cast("long"), F.lit(-(2**63)))


#: Rows of an Arrow batch that are Python objects at a time.
SLICE = 1000


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches; memory that Arrow no longer uses goes back in between.

    They are copies, not views: some Arrow functions have been seen to return wrong strings for views."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.take(pa.array(range(at, min(at + rows, batch.num_rows)), pa.int64()))
        pa.default_memory_pool().release_unused()


def map_texts(
    docs: DataFrame, of_texts: Callable[[list], list[pa.Array]], fields: str, *, ids: tuple[str, ...] = ("doc_id",), text: str = "text", rows: int = SLICE
) -> DataFrame:
    """``ids`` as they are, then the columns that ``of_texts`` makes from a batch of texts (str or None each)."""
    kinds = [docs.schema[i] for i in ids]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds] + list(T._parse_datatype_string(fields)))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows):
            made = of_texts(batch.column(len(ids)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(ids))), *made], names)

    return docs.select(*ids, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keeps: Callable[[list], list[bool]], *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns untouched, for whose texts ``keeps`` says True."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.filter(pa.array(keeps(batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
