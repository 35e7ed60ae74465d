"""From places in strains to nodes of the graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panweave.operators.graph import Graph
from panweave.operators.junctions import packed, unpacked
from panweave.operators.ranking import few_or_many

#: Bases of a bucket by which places and node occurrences are joined.
BUCKET = 1024
#: Node ids that are put in order together.
PIECE = 1 << 18


def node_paths(found: DataFrame, graph: Graph) -> DataFrame:
    """``found`` (with strain, begin, length >= k) with path (node ids in order) and dist_left.

    A match's k-mers and a node occurrence's k-mers are intervals; both are dealt to the buckets that they touch, so
    the join has equal keys and no strain's intervals are compared all with all. The occurrences are as many as the whole text
    has, so they are shuffled only if the matches are counted to be many."""
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / BUCKET), F.floor(b / BUCKET)))
    last = F.col("begin") + F.col("length") - graph.k
    keys = [c for c in found.columns]
    each = found.withColumn("last_kmer", last).filter(F.col("length") >= graph.k).withColumn("bucket", bucket(F.col("begin"), F.col("last_kmer")))
    nodes = graph.node_occ.select("strain", "node_id", "seg_ord", "seg_start", F.col("last_kmer_pos").alias("seg_last")).withColumn("bucket", bucket(F.col("seg_start"), F.col("seg_last")))
    met = nodes.join(few_or_many(each), ["strain", "bucket"]).filter("seg_start <= last_kmer and seg_last >= begin").drop("bucket").distinct()
    steps = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seg_ord", "node_id", "seg_start"))).alias("steps"))
    path = F.transform("steps", lambda x: x["node_id"])
    return steps.select(*keys, path.alias("path"), (F.col("begin") - F.col("steps")[0]["seg_start"]).alias("dist_left"))


def path_string(path, length, k: int):
    """Node ids joined by commas, or by slashes where a match is shorter than k and its nodes are a set."""
    ids = F.transform(path, lambda x: x.cast("string"))
    return F.when(length < k, F.array_join(ids, "/")).otherwise(F.array_join(ids, ","))


def subgraph_ids(paths: DataFrame) -> DataFrame:
    """subgraph_id: number of a path among its read's paths, those of the read itself first."""
    return paths.withColumn("subgraph_id", F.dense_rank().over(Window.partitionBy("read_id").orderBy("rc", "path")) - 1)


def strain_of(positions: DataFrame, starts: DataFrame) -> DataFrame:
    """``positions`` (position) with the strain and the place in it; positions on separators and outside get null.

    An as-of join by buckets of the text's positions."""
    size = 1 << 16
    touched = F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("len") - 1) / size)))
    ranges = starts.filter("len > 0").select("strain", "start", "len", touched.alias("bucket"))
    asked = positions.withColumn("bucket", F.floor(F.col("position") / size))
    on = (asked["bucket"] == ranges["bucket"]) & (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("len"))
    return asked.join(ranges, on, "left").select(*positions.columns, "strain", (F.col("position") - F.col("start")).alias("begin"))


def node_pieces(words: DataFrame, graph: Graph) -> DataFrame:
    """word, piece and nodes: the sorted ids, within a range of ``PIECE`` numbers, of the nodes whose text holds the word (shorter than k).

    Nodes are looked through once. What is shuffled is a number and a bit for each word of every node that holds some."""
    found = words.select("word").distinct().filter(F.length("word").between(1, graph.k - 1))
    asked = sorted(r[0] for r in found.collect())  # a word has fewer than k letters
    size, groups = PIECE, range(0, len(asked), 64)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids)
            edges = np.append(np.nonzero(np.append(True, np.diff(ids[order] // size) > 0))[0], len(ids)) if len(ids) else []
            out = []
            for g in groups:
                held = np.zeros(len(ids), np.uint64)
                for i, word in enumerate(asked[g : g + 64]):
                    held |= pc.match_substring(batch.column(1), word).to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(i)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    own = order[a:b][held[order[a:b]] > 0]
                    if len(own):
                        out.append((g, int(ids[own[0]]) // size, packed(rising=ids[own], held=held[own])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["first", "piece", "data"])

    def gather(table: pa.Table) -> pa.Table:
        first, piece = table.column("first")[0].as_py(), table.column("piece")[0].as_py()
        rows = [unpacked(d) for d in table.column("data").to_pylist()]
        ids, held = (np.concatenate([x[c] for x in rows]) for c in ("rising", "held"))
        order = np.argsort(ids)
        ids, held = ids[order], held[order]
        out = [(word, piece, ids[held >> np.uint64(i) & np.uint64(1) == 1]) for i, word in enumerate(asked[first : first + 64])]
        out = [x for x in out if len(x[2])]
        return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], ["word", "piece", "nodes"])

    looked = graph.nodes.select("node_id", "omega").mapInArrow(look, "first long, piece long, data binary")
    return looked.groupBy("first", "piece").applyInArrow(gather, "word string, piece long, nodes array<long>")


def nodes_under_k(words: DataFrame, graph: Graph) -> DataFrame:
    """``words`` (word, shorter than k) with the sorted ids of the nodes whose text holds them."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("piece", "nodes"))), lambda x: x["nodes"])
    return node_pieces(words, graph).groupBy("word").agg(F.flatten(pieces).alias("nodes"))


def nodes_under_k_text(words: DataFrame, graph: Graph) -> DataFrame:
    """nodes_under_k() with the ids joined by slashes, by pieces: an id of a long list is never an object of its own."""
    pieces = node_pieces(words, graph).select("word", "piece", path_string(F.col("nodes"), F.length("word"), graph.k).alias("text"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"])
    return pieces.groupBy("word").agg(F.array_join(texts, "/").alias("nodes"))
