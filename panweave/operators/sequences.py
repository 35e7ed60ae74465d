"""Strains, reads and the windows (k-mers, q-grams) of strains.

A strain is cut into blocks before its windows are listed, so that no task holds the windows of a whole strain
at once, and windows are byte slices, which cost their own length wherever they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panweave.functions.dna import dna, revcomp
from panweave.operators.ranking import few_or_many, numbered, prefix_sums

BLOCK = 1 << 14
#: Reads that one item may be cut into.
PARTS = 1_000_000


def strains_of(docs: DataFrame, k: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """strain, seq and len of every row with at least k bases."""
    out = docs.select(F.col(id_column).cast("long").alias("strain"), dna(F.col(text_column)).alias("seq"))
    return out.withColumn("len", F.length("seq").cast("long")).filter(F.col("len") >= k)


def with_starts(strains: DataFrame) -> DataFrame:
    """start: place of each strain in the text that has a separator after every strain. Strains are numbered by range
    partitions and their lengths summed in two levels, so many small strains are no single task's work."""
    sizes = numbered(strains.select("strain", (F.col("len") + 1).alias("_size")), "_number", "strain")
    starts = prefix_sums(sizes, "_size", "_number").select("strain", F.col("before").alias("start"))
    return strains.join(starts, "strain")


def blocks(strains: DataFrame, width: int, *, margin: int = 1) -> DataFrame:
    """strain, len, at (first place) and block: overlapping cuts that hold every window of this width with its margins."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - width, F.lit(BLOCK).cast("long")))
    cut = strains.filter(F.col("len") >= width).select("strain", "len", F.col("seq").cast("binary").alias("seq"), begin.alias("at"))
    lead = F.least(F.col("at"), F.lit(margin))
    return cut.select("strain", "len", "at", lead.cast("int").alias("lead"), F.substring("seq", (F.col("at") - lead + 1).cast("int"), (lead + BLOCK + width - 1 + margin).cast("int")).alias("block"))


def slices(wanted: DataFrame, strains: DataFrame, width: int, *, stored: bool = False) -> DataFrame:
    """``wanted`` (with strain, begin and size up to ``width``) with the text there; clipped at the strain's end.

    Strains are joined as blocks, so a row never carries a whole strain."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len"), F.lit(BLOCK).cast("long")))
    parts = strains.filter("len > 0").select("strain", "len", F.col("seq").cast("binary").alias("seq"), begin.alias("_at"))
    parts = parts.select("strain", "len", "_at", F.substring("seq", (F.col("_at") + 1).cast("int"), F.lit(BLOCK + width)).alias("_block"))
    joined = parts.join(few_or_many(wanted.withColumn("_at", F.col("begin") - F.col("begin") % BLOCK), stored=stored), ["strain", "_at"])
    text = F.substring("_block", (F.col("begin") - F.col("_at") + 1).cast("int"), F.col("size").cast("int")).cast("string")
    return joined.withColumn("text", text).drop("_at", "_block")


def long_slices(wanted: DataFrame, strains: DataFrame, *, width: int = 1 << 10) -> DataFrame:
    """``wanted`` (a stored table with strain, begin and size; its rows distinct) with the text there, of any length.

    What is longer than ``width`` is cut out of each block that it touches, and its pieces are joined."""
    short = slices(wanted.filter(F.col("size") <= width), strains, width, stored=True).select(*wanted.columns, "text")
    if (long := wanted.filter(F.col("size") > width)).isEmpty():
        return short
    start, end = F.col("begin"), F.col("begin") + F.col("size")
    at = F.explode(F.sequence(start - start % BLOCK, end - 1 - (end - 1) % BLOCK, F.lit(BLOCK).cast("long")))
    touched = long.select(F.struct(*wanted.columns).alias("_whole"), "strain", start.alias("_from"), end.alias("_to"), at.alias("_block_at"))
    begin = F.greatest("_from", "_block_at")
    pieces = touched.select("_whole", "strain", begin.alias("begin"), (F.least(F.col("_to"), F.col("_block_at") + BLOCK) - begin).alias("size"))
    cuts = slices(pieces, strains, 0, stored=True).groupBy("_whole").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("_pieces"))
    return short.unionByName(cuts.select("_whole.*", F.array_join("_pieces.text", "").alias("text")))


def windows(strains: DataFrame, width: int, *, neighbours: bool = False) -> DataFrame:
    """strain, pos and gram of every window; with neighbours also prev and next, the codes of the characters there.

    Outside a strain, next is a number of the strain's own (below zero), and prev is that of "%" ("$" for the first
    strain). Numbers, unlike strings, can be aggregated in place; a window is cut from its block only when it is
    asked for, within generated code."""
    n = F.least(F.col("len") - width - F.col("at"), F.lit(BLOCK - 1)).cast("int")
    rows = blocks(strains, width).select("strain", "len", "at", "lead", "block", F.explode(F.sequence(F.lit(0), n)).alias("i"))
    pos, place = F.col("at") + F.col("i"), F.col("lead") + F.col("i")
    gram = F.substring("block", place + 1, F.lit(width)).cast("string").alias("gram")
    if not neighbours:
        return rows.select("strain", pos.alias("pos"), gram)
    code = lambda i: F.ascii(F.substring("block", i, F.lit(1)).cast("string"))
    first = strains.agg(F.min("strain").alias("first_strain"))
    # One row of one number is joined.
    rows = rows.crossJoin(F.broadcast(first))
    outside = F.when(F.col("strain") == F.col("first_strain"), ord("$")).otherwise(ord("%"))
    prev = F.when(pos > 0, code(place)).otherwise(outside)
    following = F.when(pos + width < F.col("len"), code(place + 1 + width).cast("long")).otherwise(-F.col("strain") - 1)
    return rows.select("strain", pos.alias("pos"), gram, prev.alias("prev"), following.alias("next"))


def reads_of(rows: DataFrame, length: int, *, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """read_id (item * PARTS + number) and seq: consecutive pieces of this length of each row's bases; the last one takes the rest."""
    seq = rows.select(F.col(id_column).cast("long").alias("item"), dna(F.col(text_column)).alias("seq"))
    count = F.greatest(F.floor(F.length("seq") / length), F.lit(1)).cast("int")
    pieces = seq.withColumn("count", count).select("item", "seq", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("part"))
    size = F.when(F.col("part") + 1 < F.col("count"), length).otherwise(F.length("seq"))
    read = F.substring(F.col("seq"), F.col("part") * length + 1, size)
    return pieces.select((F.col("item") * PARTS + F.col("part")).alias("read_id"), read.alias("seq")).filter("seq <> ''")


def mutated(reads: DataFrame) -> DataFrame:
    """Reads with one base replaced, at a place that depends on the read."""
    at = F.pmod(F.col("read_id") * 7, F.length("seq")).cast("int")
    base = F.translate(F.substring(F.col("seq"), at + 1, F.lit(1)), "ACGT", "CGTA")
    return reads.withColumn("seq", F.concat(F.substring(F.col("seq"), F.lit(1), at), base, F.substring(F.col("seq"), at + 2, F.length("seq"))))


def both_ways(reads: DataFrame) -> DataFrame:
    """Each read as it is (rc 0) and its reverse complement (rc 1)."""
    ways = F.array(F.struct(F.lit(0).alias("rc"), F.col("seq").alias("seq")), F.struct(F.lit(1).alias("rc"), revcomp(F.col("seq")).alias("seq")))
    return reads.select("read_id", F.inline(ways))


def without_n(reads: DataFrame) -> DataFrame:
    return reads.filter(~F.col("seq").contains("N"))
