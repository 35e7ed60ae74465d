"""Token counts from flat token files without an index.

A token file is a run of ids of fixed width in which each document ends with a separator id; it is stored as
blocks of equal size that know nothing of documents. The scan finds the separators of each block with one
vectorised comparison. Boundaries are stitched by a prefix scan over the blocks: how many separators lie before a
block, and where the last one does. The scan has two levels, within segments of SEGMENT blocks and over segments,
so that a single huge file isn't one task's work.

Defined cases: null and empty texts are documents of no tokens. Empty tables give no blocks and no rows. Repeated
rows are stored and counted one by one. Separators side by side enclose a document of no tokens. Tokens after
the last separator of a file are a last document with ended = false. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panweave.llm.common import sliced, stored
from panweave.llm.word_tokens import word_tokens

BLOCK, SEGMENT, SEPARATOR, WIDTH = 1 << 16, 256, 49407, 2
#: Texts encoded together: the more, the more runs they share; the fewer, the less memory.
TEXTS = 5000
#: Blocks that a task reads from raw files.
BLOCKS_OF_A_TASK = 512
ROWS = "file long, place long, data binary, doc_id long"


def narrowed(ids: np.ndarray, width: int, separator: int) -> bytes:
    """Ids of this many bytes each."""
    if len(ids) and int(ids.max()) >= 1 << 8 * width:
        raise ValueError(f"an id doesn't fit {width} bytes")
    if (ids == separator).any():
        raise ValueError("the separator is an id of a text")
    return ids.astype(f"<u{width}").tobytes()


def write_token_files(docs: DataFrame, path: str, *, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Token files, one for each partition of the documents: their blocks (file, block, data), and their order of
    documents (file, ordinal, doc_id), which the scan doesn't need."""
    names = ["file", "place", "data", "doc_id"]
    size = block * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, waiting, n_blocks, n_docs = TaskContext.get().partitionId(), b"", 0, 0
        end = np.array([separator], f"<u{width}").tobytes()

        def rows(blocks: list[bytes], ids: list) -> pa.RecordBatch:
            places = [*range(n_blocks, n_blocks + len(blocks)), *range(n_docs, n_docs + len(ids))]
            columns = [[file] * len(places), places, [*blocks, *[None] * len(ids)], [*[None] * len(blocks), *ids]]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names)

        for batch in sliced(batches, TEXTS):
            made = [narrowed(np.frombuffer(x, "<u4"), width, separator) + end for x in word_tokens(path).ids(batch.column(1))]
            data = b"".join([waiting, *made])
            full = len(data) // size
            ids = batch.column(0).to_pylist()
            yield rows([data[i * size : (i + 1) * size] for i in range(full)], ids)
            waiting, n_blocks, n_docs = data[full * size :], n_blocks + full, n_docs + len(ids)
        if waiting:
            yield rows([waiting], [])

    table = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS), "token_files")
    blocks = table.filter(F.col("data").isNotNull()).select("file", F.col("place").alias("block"), "data")
    return blocks, table.filter(F.col("data").isNull()).select("file", F.col("place").alias("ordinal"), "doc_id")


def read_flat_files(spark: SparkSession, path: str, *, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Blocks (file, block, data) of raw files under a path; file is a hash of the file's name.

    Spark lists the files; each task reads the ranges of its blocks, so a file of any size is shared out. A file that ends
    within an id raises ValueError. Paths must be of a file system that pyarrow knows."""
    size = block * width
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")  # not their contents
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / size) - 1)).alias("block"))
    tasks = max(1, (ranges.agg(F.sum("length")).first()[0] or 0) and -(-ranges.count() // BLOCKS_OF_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for name, length, number in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{name} ends within an id")
                system, place = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", name))
                with system.open_input_file(place) as f:
                    data = f.read_at(min(size, length - number * size), number * size)
                file = xxhash.xxh64_intdigest(name.encode()) - 2**63
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])

    return ranges.repartition(tasks).mapInArrow(run, "file long, block long, data binary")


def find_separators(blocks: DataFrame, *, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, block, ends (places of the separators in the file) and stop (place after the block's last token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ends, stops = batch.column(1).to_pylist(), [], []
            for number, data in zip(numbers, batch.column(2), strict=True):
                ids = np.frombuffer(data.as_buffer(), f"<u{width}")
                ends.append(np.flatnonzero(ids == separator) + number * block)
                stops.append(number * block + len(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(stops, pa.int64())], ["file", "block", "ends", "stop"])

    return blocks.select("file", "block", "data").mapInArrow(run, "file long, block long, ends array<long>, stop long")


def count_tokens(blocks: DataFrame, *, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens and ended of every document in the token files."""
    found = find_separators(blocks, separator=separator, width=width, block=block)
    found = found.withColumn("segment", F.floor(F.col("block") / SEGMENT)).withColumn("n", F.size("ends").cast("long")).withColumn("last", F.array_max("ends"))
    before = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    segments = found.groupBy("file", "segment").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    carried = segments.select(
        "file", "segment", F.coalesce(F.sum("n").over(w := before("file", by="segment")), F.lit(0)).alias("n_before"), F.max("last").over(w).alias("last_before")
    )
    w = before("file", "segment", by="block")
    stitched = (
        found.withColumn("n_here", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("last_here", F.max("last").over(w))
        .join(carried, ["file", "segment"])
        .select("file", "ends", (F.col("n_before") + F.col("n_here")).alias("ordinal"), F.coalesce("last_here", "last_before", F.lit(-1)).alias("last"))
    )
    each = stitched.select("file", "ordinal", "last", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("last")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1)))) + 1
    whole = each.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    files = found.groupBy("file").agg(F.max("stop").alias("stop"), F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"))
    rest = files.filter("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def count_document_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id with file, ordinal, start and n_tokens, by writing the token files and scanning them."""
    blocks, order = write_token_files(docs, path)
    return count_tokens(blocks).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
