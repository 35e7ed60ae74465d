"""Numbers 0, 1, 2, ... over a whole table without sending all rows to one task."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut(df: DataFrame) -> DataFrame:
    """Store ``df`` in the session's shared checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


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


#: Bytes of a row group of stored tables, looked at after each row: a reader holds as many rows of a group as it can, however long they are.
GROUP = 8 << 20


def stored(df: DataFrame) -> DataFrame:
    """As cut(), but in compressed columns: for large tables. The files stay until drop()."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": GROUP, "parquet.page.size.row.check.min": 1}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Delete the files of a table that stored() has made."""
    context = table.sparkSession.sparkContext
    for folder in {x.rpartition("/")[0] for x in table.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what is no longer in use; it does so when the driver's garbage is collected."""
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return
    for _ in range(2):  # what Python held goes first
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


#: Rows of a few short columns that are sent to every task rather than shuffled for.
FEW = 200_000


def few_or_many(df: DataFrame, rows: int = FEW, *, stored: bool = False) -> DataFrame:
    """``df`` stored (if it isn't yet), and marked for broadcasting if it is counted to have no more than ``rows`` rows.

    The other side of a join is often the whole text; then it needn't be shuffled. With more rows, the join shuffles
    both sides, and Spark may split what a hot key gets."""
    kept = df if stored else cut(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def prefix_sums(rows: DataFrame, value: str, order: str, *, bucket: int = 1 << 16) -> DataFrame:
    """``rows`` with before: the sum of ``value`` over rows of smaller ``order`` (distinct numbers from 0)."""
    return all_prefix_sums(rows, {"before": F.col(value)}, order, bucket=bucket)


def all_prefix_sums(rows: DataFrame, values: dict[str, Column], order: str, *, bucket: int = 1 << 16) -> DataFrame:
    """``rows`` with, under each name, the sum of the value over rows of smaller ``order`` (distinct numbers from 0).

    In three levels: cells of ``bucket`` numbers, blocks of ``bucket`` cells, and the blocks, which alone meet in one task.
    ``rows`` are read twice."""
    up_to = lambda *keys, by: (Window.partitionBy(*keys) if keys else Window).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    running = lambda prefix, window: {f"{prefix}{n}": F.coalesce(F.sum(f"_of_{n}").over(window), F.lit(0)) for n in values}
    total = [F.sum(f"_of_{n}").alias(f"_of_{n}") for n in values]
    cells = rows.withColumns({f"_of_{n}": v for n, v in values.items()}).withColumn("_cell", F.floor(F.col(order) / bucket))
    sums = cells.groupBy("_cell").agg(*total).withColumn("_block", F.floor(F.col("_cell") / bucket))
    blocks = sums.groupBy("_block").agg(*total).withColumns(running("_first_", up_to(by="_block"))).drop(*(f"_of_{n}" for n in values))
    offsets = sums.withColumns(running("_offset_", up_to("_block", by="_cell"))).drop(*(f"_of_{n}" for n in values)).join(blocks, "_block")
    placed = cells.withColumns(running("_inside_", up_to("_cell", by=order))).join(offsets, "_cell")
    out = placed.withColumns({n: F.col(f"_first_{n}") + F.col(f"_offset_{n}") + F.col(f"_inside_{n}") for n in values})
    return out.drop("_cell", "_block", *(f"_{part}_{n}" for n in values for part in ("of", "first", "offset", "inside")))


def earlier(rows: DataFrame, keys: list[str], order: str, value: str, *, width: int = 1 << 16) -> DataFrame:
    """``rows`` with _last, the greatest ``value`` among rows of the same keys and smaller ``order`` (distinct whole numbers),
    null if there is none, and _before, the number of those rows.

    In two levels, as prefix_sums(): cells of ``width`` numbers, then one summary of each cell, so that a key with very many
    rows isn't a single task's work. ``rows`` are read twice and should be stored."""
    cells = rows.withColumn("_cell", F.floor(F.col(order) / width))
    up_to = lambda *by, within: Window.partitionBy(*within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside, across = up_to(order, within=[*keys, "_cell"]), up_to("_cell", within=keys)
    sums = cells.groupBy(*keys, "_cell").agg(F.max(value).alias("_max"), F.count("*").alias("_n"))
    carried = sums.select(*keys, "_cell", F.max("_max").over(across).alias("_carried"), F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    placed = cells.withColumn("_last", F.max(value).over(inside)).withColumn("_before", F.count("*").over(inside)).join(carried, [*keys, "_cell"])
    found = placed.withColumn("_last", F.greatest("_last", "_carried")).withColumn("_before", F.col("_before") + F.col("_offset"))
    return found.drop("_cell", "_carried", "_offset")


def numbered(df: DataFrame, name: str, *order, store=cut) -> DataFrame:
    """``df`` with its rank by ``order``, from 0. Rows are range-partitioned and sorted; only the partitions' sizes
    meet in one place. Ties get any order, so ``order`` should be a key."""
    parted = store(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id()))
    part, row = F.shiftright("_row", 33).alias("_part"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = parted.groupBy(part).count()
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    joined = parted.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # a row for each partition
    return joined.withColumn(name, F.col("_offset") + row).drop("_part", "_row", "_offset")
