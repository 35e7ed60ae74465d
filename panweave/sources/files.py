"""Genome and read files, result files, and the stored index."""

from __future__ import annotations

import os
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panweave.functions.dna import iupac_clean

FASTA, FASTQ = (".fasta", ".fa", ".fna"), (".fastq", ".fq")
GENOMES = "*.{fasta,fa,fna,FASTA}"


def fasta_records(spark: SparkSession, path: str, *, glob: str = GENOMES) -> DataFrame:
    """file, header and seq of every record; a path may be a folder, of which the files that ``glob`` names are read.

    The reader splits records at ">" at the start of a line, so a large file is read by many tasks, and headers may
    hold that character."""
    return _records(spark, path, glob).select("file", "header", "seq")


def _records(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The same with at: records of a file rise by it."""
    reader = spark.read.option("lineSep", "\n>").option("pathGlobFilter", glob)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = reader.text(path).select(F.input_file_name().alias("file"), at.alias("at"), "value").filter("trim(value) <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return rows.select("file", "at", F.regexp_replace(head, "^>|\r$", "").alias("header"), F.regexp_replace(body, "[\r\n]", "").alias("seq"))


def fasta_strains(spark: SparkSession, path: str, *, glob: str = GENOMES) -> DataFrame:
    """strain, name and seq: each file is a strain, its contigs put together in order, ambiguity codes resolved."""
    contigs = F.array_sort(F.collect_list(F.struct("at", "seq")))
    strains = _records(spark, path, glob).groupBy(F.col("file").alias("name")).agg(F.array_join(F.transform(contigs, lambda x: x["seq"]), "").alias("seq"))
    return _numbered(strains.select("name", iupac_clean(F.col("seq")).alias("seq")), "name")


def fasta_contigs(spark: SparkSession, path: str, *, glob: str = GENOMES) -> DataFrame:
    """strain, name and seq: each record is a strain."""
    records = fasta_records(spark, path, glob=glob)
    return _numbered(records.select("file", F.col("header").alias("name"), iupac_clean(F.col("seq")).alias("seq")), "file", "name").drop("file")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    # Strains are few: the window sorts their names only.
    names = rows.select(*order).distinct().withColumn("strain", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return rows.join(names, list(order))


def preprocessed_text(spark: SparkSession, path: str) -> DataFrame:
    """strain and seq of a text over ACGT with "%" between strains and "$" at the end."""
    whole = spark.read.text(path, wholetext=True).select(F.rtrim(F.regexp_replace("value", "[\\r\\n]+$", "")).alias("t"))
    parts = whole.select(F.posexplode(F.split(F.regexp_replace("t", "\\$$", ""), "%")).alias("strain", "seq"))
    return parts.select(F.col("strain").cast("long").alias("strain"), "seq")


def check_strains(strains: DataFrame) -> None:
    """At least two strains, over A, C, G and T."""
    found = strains.agg(F.count("*").alias("n"), F.sum(F.when(F.col("seq").rlike("[^ACGT]") | F.col("seq").isNull(), 1).otherwise(0)).alias("bad")).first()
    if found["n"] < 2:
        raise ValueError("a pan-genome needs at least two strains")
    if found["bad"]:
        raise ValueError(f"{found['bad']} strains have characters other than A, C, G and T")


def fasta_reads(spark: SparkSession, path: str, *, glob: str = GENOMES) -> DataFrame:
    """read_id (the whole header) and seq."""
    return fasta_records(spark, path, glob=glob).select(F.col("header").alias("read_id"), F.upper("seq").alias("seq"))


def fastq_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id and seq of records of four lines. A quality line may begin with "@": lines go by their number.

    Lines are numbered from the sizes of the reader's splits, so neither a file nor its lines meet in one task."""
    place = F.monotonically_increasing_id()  # rises by one within a split
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("split"), place.alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))  # a row for each split
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(splits.select("file", "split", "first", before.alias("before")), ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("i"), "line")
    kind = F.col("i") % 4
    heads = F.max(F.when(kind == 0, F.expr("substring(line, 2)")))
    reads = numbered.filter(kind < 2).groupBy("file", F.floor(F.col("i") / 4).alias("record")).agg(heads.alias("read_id"), F.max(F.when(kind == 1, F.upper("line"))).alias("seq"))
    return reads.filter("seq is not null").select("read_id", "seq")


def csv_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id and seq: the second and third column of a file with a header."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(rows.columns[1]).alias("read_id"), F.upper(F.col(rows.columns[2])).alias("seq"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """read_id and seq by the file's extension."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind in FASTA:
        return fasta_reads(spark, path)
    if kind in FASTQ:
        return fastq_reads(spark, path)
    if kind == ".csv":
        return csv_reads(spark, path)
    raise ValueError(f"reads of kind {kind or 'unknown'} aren't supported")


def write_fasta(rows: DataFrame, path: str, *, header: str = "read_id", seq: str = "seq") -> None:
    """Records of two lines, in files under ``path``."""
    text = rows.select(F.concat(F.lit(">"), F.col(header).cast("string"), F.lit("\n"), F.col(seq)).alias("value"))
    text.write.text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated values with a header."""
    rows.write.option("sep", "\t").option("header", True).mode("overwrite").csv(path)


#: Header of an edge file; some names stand twice there, so columns are renamed only on writing.
EDGE_COLUMNS = ["EdgeKey", "Source", "OmegaShort", "OmegaFull", "PartOfPath", "Target", "OmegaShort", "OmegaFull", "PartOfPath", "Color", "EdgeMultiplicity"]


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges of a subgraph as tab-separated lines; each file has the header that graph viewers expect."""
    order = ["edge_key", "src", "src_omega_short", "src_omega_full", "src_part_of_path", "dst", "dst_omega_short", "dst_omega_full", "dst_part_of_path", "color", "multiplicity"]
    lines = edges.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in order)).alias("value"))

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(["\t".join(EDGE_COLUMNS)])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)


def write_style(path: str, n_strains: int, name: str = "pan-genome") -> None:
    """A viewer's style: edge colours run from the first strain over the middle one to the last, path nodes stand out."""
    root = ET.Element("vizmap", id=name, documentVersion="3.0")
    style = ET.SubElement(root, "visualStyle", name=name)
    nodes, edges = ET.SubElement(style, "node"), ET.SubElement(style, "edge")
    label = ET.SubElement(nodes, "visualProperty", name="NODE_LABEL", default="")
    ET.SubElement(label, "passthroughMapping", attributeName="OmegaShort", attributeType="string")
    fill = ET.SubElement(nodes, "visualProperty", name="NODE_FILL_COLOR", default="#E1E1E1")
    on_path = ET.SubElement(fill, "discreteMapping", attributeName="PartOfPath", attributeType="boolean")
    ET.SubElement(on_path, "discreteMappingEntry", attributeValue="true", value="#FFA500")
    width = ET.SubElement(edges, "visualProperty", name="EDGE_WIDTH", default="2.0")
    ET.SubElement(width, "passthroughMapping", attributeName="EdgeMultiplicity", attributeType="integer")
    for prop in ("EDGE_UNSELECTED_PAINT", "EDGE_TARGET_ARROW_UNSELECTED_PAINT"):
        paint = ET.SubElement(edges, "visualProperty", name=prop, default="#848484")
        mapping = ET.SubElement(paint, "continuousMapping", attributeName="Color", attributeType="integer")
        # Magenta, yellow, cyan.
        for at, color in ((0, "#FF00FF"), ((n_strains - 1) / 2, "#FFFF00"), (n_strains - 1, "#00FFFF")):
            ET.SubElement(mapping, "continuousMappingPoint", attrValue=str(float(at)), lesserValue=color, equalValue=color, greaterValue=color)
    ET.indent(root)
    ET.ElementTree(root).write(path, encoding="UTF-8", xml_declaration=True)


def save_index(graph, path: str) -> None:
    """Strains, and the graph's tables under a folder for k: other k's tables, and the strains, stay. An index of other
    strains raises ValueError."""
    mark = lambda rows: tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("strain", "seq").cast("decimal(38,0)"))).first())
    graph.strains.write.mode("ignore").parquet(f"{path}/strains")
    if mark(graph.strains.sparkSession.read.parquet(f"{path}/strains")) != mark(graph.strains):
        raise ValueError(f"{path} is an index of other strains")
    for name in ("nodes", "node_occ", "edges"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{path}/{name}/k={graph.k}")


def load_index(spark: SparkSession, path: str, k: int) -> dict[str, DataFrame]:
    """The tables that save_index() wrote for this k."""
    return {"strains": spark.read.parquet(f"{path}/strains")} | {n: spark.read.parquet(f"{path}/{n}/k={k}") for n in ("nodes", "node_occ", "edges")}
