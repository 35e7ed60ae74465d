"""The compacted de Bruijn graph of strains, by aggregation.

A k-mer is right-maximal if more than one character follows it somewhere, left-maximal if more than one precedes it.
A strain is cut after each right-maximal k-mer and before each left-maximal one; the pieces between cuts are
node occurrences, and pieces with the same last k-mer are the same node. What is left after the last cut, with the
separator, is the strain's end node. Cuts are found among packed runs of k-mers (see ``junctions``); without them (letters other
than bases, long k-mers) only branching k-mers are joined back to their places, so of all k-mers just the few at cuts are
ever sorted, by cells of their strain. Texts are cut out of blocks, not of whole strains.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panweave.operators import junctions as J
from panweave.operators import sequences
from panweave.operators.ranking import cut, drop, earlier, few_or_many, numbered, release, stored
from panweave.operators.sequences import long_slices, windows

RIGHT, LEFT, END = "right_maximal", "pre_left_maximal", "end"


def branching(kmers: DataFrame) -> DataFrame:
    """gram, rm, lm of the k-mers that are right- or left-maximal. The aggregation combines before its shuffle."""
    sides = kmers.groupBy("gram").agg(F.min("next").alias("n0"), F.max("next").alias("n1"), F.min("prev").alias("p0"), F.max("prev").alias("p1"))
    flags = sides.select("gram", (F.col("n0") != F.col("n1")).alias("rm"), (F.col("p0") != F.col("p1")).alias("lm"))
    return flags.filter("rm or lm")


def maximal(strains: DataFrame, k: int, right: bool) -> DataFrame:
    """kmer, n and n_sides of the right-maximal (left-maximal) k-mers: how often each occurs and how many characters follow (precede)."""
    if made := packed_blocks(strains, k):
        blocks, first, buckets = made
        return J.maximal(blocks, k, buckets, first, right)
    kmers = windows(strains, k, neighbours=True)
    # Only branching k-mers are counted in detail.
    few = kmers.join(branching(kmers).filter("rm" if right else "lm").select("gram"), "gram", "left_semi")
    return few.groupBy(F.col("gram").alias("kmer")).agg(F.count("*").alias("n"), F.count_distinct("next" if right else "prev").alias("n_sides"))


def segments(strains: DataFrame, k: int) -> DataFrame:
    """strain, seg_ord, seg_start (first base), last_kmer_pos, kind, omega of every node occurrence, end nodes included."""
    kmers = windows(strains, k, neighbours=True)
    flagged = kmers.select("strain", "pos", "gram").join(few_or_many(branching(kmers)), "gram")
    cuts = cut(flagged.select("strain", F.explode(F.array(
        F.struct(F.when(F.col("rm"), F.col("pos")).alias("cut"), F.lit(True).alias("rm")),
        F.struct(F.when(F.col("lm") & (F.col("pos") > 0), F.col("pos") - 1).alias("cut"), F.lit(False).alias("rm")),
    )).alias("c")).select("strain", "c.cut", "c.rm").filter("cut is not null").groupBy("strain", "cut").agg(F.max("rm").alias("rm")))
    start = F.coalesce(F.col("_last") + 1, F.lit(0).cast("long"))
    closed = earlier(cuts, ["strain"], "cut", "cut").select("strain", F.col("_before").alias("seg_ord"), start.alias("seg_start"), F.col("cut").alias("last_kmer_pos"), F.when(F.col("rm"), RIGHT).otherwise(LEFT).alias("kind"))
    tails = cuts.groupBy("strain").agg(F.max("cut").alias("cut"), F.count("*").cast("int").alias("n"))
    ends = strains.select("strain", "len").join(tails, "strain", "left").select(
        "strain", F.coalesce("n", F.lit(0)).alias("seg_ord"), (F.coalesce("cut", F.lit(-1)) + 1).alias("seg_start"), (F.col("len") - k + 1).alias("last_kmer_pos"), F.lit(END).alias("kind"),
    )
    size = F.col("last_kmer_pos") + k - F.col("seg_start")
    placed = long_slices(cut(closed.unionByName(ends)).withColumn("begin", F.col("seg_start")).withColumn("size", size), strains)
    # An end node's text has the separator in place of its last character.
    omega = F.when(F.col("kind") == END, F.concat("text", F.lit("%"))).otherwise(F.col("text"))
    return placed.select("strain", F.col("seg_ord").cast("int").alias("seg_ord"), "seg_start", "last_kmer_pos", "kind", omega.alias("omega"))


def packed_blocks(strains: DataFrame, k: int) -> tuple[DataFrame, int, int] | None:
    """The strains' packed blocks, stored, the smallest strain, and how many buckets the junctions need; nothing if they can't be
    packed: other letters than bases, or a k that doesn't fit."""
    if not 1 < k <= J.MOST_K:
        return None
    blocks = stored(J.pack(strains, k, sequences.BLOCK))
    first, total, odd = blocks.agg(F.min("first"), F.sum("bases"), F.max("odd")).first()
    if odd or first is None:
        drop(blocks)
        return None
    spread = 2 * strains.sparkSession.sparkContext.defaultParallelism if total > J.BUCKET else 1
    return blocks, first, max(spread, total // J.BUCKET)


class Graph:
    """nodes (node_id, kind, omega, len, multiplicity), node_occ (node_id, strain, seg_ord, seg_start, seg_end) and
    edges (src, dst, strain, multiplicity) of strains.

    With ``nodes_only`` there are just the nodes, and which follow which: of their occurrences only the first ones are put in order, and
    none is stored."""

    def __init__(self, strains: DataFrame, k: int, *, nodes_only: bool = False):
        self.k, self.strains, self.node_occ = k, strains, None
        if made := packed_blocks(strains, k):
            self._from_junctions(*made, nodes_only)
        else:
            self._from_windows()

    def _from_junctions(self, blocks: DataFrame, first: int, buckets: int, nodes_only: bool) -> None:
        """Cells, stored: the packed occurrences, what is carried from cell to cell, and the texts of nodes."""
        k, spark, block = self.k, self.strains.sparkSession, sequences.BLOCK
        few = {"few_places": True} if nodes_only else {}
        found = self._by_parts(lambda **part: J.cuts(blocks, k, buckets, first, **few, **part), min(J.ROUNDS, -(-buckets // J.ROUND)))
        # A few codes of each bucket choose ranges of codes; only the sizes of the ranges meet in one place.
        looked_at = J.samples(found).toPandas()
        inner = int(looked_at["n"].sum())
        codes = np.sort(looked_at["code"].to_numpy(np.int64))
        borders = np.unique(codes[np.linspace(0, len(codes) - 1, inner // J.RANGE + 2).astype(np.int64)[1:-1]]) if len(codes) else codes
        ranks = stored(J.ranked(found, borders))
        sizes = ranks.groupBy("range").agg(F.max("size").alias("size"))
        before = sizes.select("range", F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        placed = ranks.join(F.broadcast(before), "range").select("bucket", "begin", "before", "data")
        ends = numbered(J.strains_in(blocks), "node_id", "strain", store=stored).withColumn("node_id", F.col("node_id") + F.lit(inner).cast("long"))
        release(spark)
        cells = self._by_parts(lambda **part: J.cells(blocks, found, placed, ends, k, block, **few, **part), min(J.CELL_ROUNDS, -(-buckets // J.ROUND)))
        for table in (blocks, found, ranks, ends):
            drop(table)
        del placed, before, sizes
        release(spark)
        packed = cells.filter(F.col("what") == J.OCCURRENCES)
        over = cut(J.parts_over(packed))
        order = Window.partitionBy("strain").orderBy(F.desc("key"))  # cells are counted down
        # Two rows of a cell at most.
        carried = cut(over.select(
            "key", (F.col("n")).alias("n"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
            F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("last"),
            F.first("first_node", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
        ).groupBy("key").agg(F.max("before").alias("carried_n"), F.max("last").alias("carried_last"), F.max("next").alias("carried_next")))
        occurrences = packed.select("key", "data").join(F.broadcast(carried), "key", "left")
        kind = F.element_at(F.array(*map(F.lit, (RIGHT, LEFT, END))), F.col("kind") + 1)
        rows = J.occurrence_rows(occurrences)
        if not nodes_only:
            self._cells = occurrences
            self.node_occ = rows.select("node_id", "strain", "seg_ord", "seg_start", (F.col("last_kmer_pos") + k).alias("seg_end"), "last_kmer_pos", kind.alias("kind"))
        self._texts = J.text_rows(cells)
        self._packed_texts = cells.filter(F.col("what") == J.TEXTS).select("data")
        open_ = J.open_rows(cells)
        self._over = not over.isEmpty()
        if self._over and not open_.isEmpty():
            place = F.min(F.struct("strain", "seg_start", "seg_end")).alias("at")
            at = rows.withColumn("seg_end", F.col("last_kmer_pos") + k - (F.col("kind") == 2).cast("int")).join(F.broadcast(cut(open_.drop("key"))), ["node_id", "kind"])  # one of each cell at most
            wanted = cut(at.groupBy("node_id", "kind", "multiplicity", "follows").agg(place).select("node_id", "kind", "multiplicity", "follows", "at.strain", F.col("at.seg_start").alias("begin"), (F.col("at.seg_end") - F.col("at.seg_start")).alias("size")))
            texts = cut(sequences.long_slices(wanted, self.strains))
            self._texts = self._texts.unionByName(texts.select("node_id", "kind", F.col("text").alias("omega"), "multiplicity"))
            self._packed_texts = self._packed_texts.unionByName(cut(J.packed_texts(texts.withColumnRenamed("text", "omega"))))
        omega = F.when(F.col("kind") == 2, F.concat("omega", F.lit("%"))).otherwise(F.col("omega")).alias("omega")
        self._texts = self._texts.select("node_id", kind.alias("kind"), omega, "multiplicity")

    @staticmethod
    def _by_parts(make, parts: int) -> DataFrame:
        """Stored one after the other, so that what one part shuffles is gone before the next one does."""
        out = None
        for part in range(parts):
            made = stored(make(part=part, parts=parts))
            release(made.sparkSession)
            out = made if out is None else out.unionByName(made)
        return out

    def _from_windows(self) -> None:
        """The same a row for each k-mer: for other letters, and k-mers that no number holds."""
        strains, k = self.strains, self.k
        self._cells = self._packed_texts = None
        found = cut(segments(strains, k))
        inner = found.filter(F.col("kind") != END).withColumn("last_kmer", F.substring(F.col("omega"), -k, k))
        nodes = inner.groupBy("last_kmer").agg(F.min("kind").alias("kind"), F.min("omega").alias("omega"), F.count("*").alias("multiplicity"))
        ends = found.filter(F.col("kind") == END).select(F.lit("").alias("last_kmer"), "kind", "omega", F.lit(1).cast("long").alias("multiplicity"), "strain")
        rank = F.when(F.col("kind") == RIGHT, 0).when(F.col("kind") == LEFT, 1).otherwise(2)
        ranked = nodes.withColumn("strain", F.lit(-1).cast("long")).unionByName(ends).withColumn("kind_rank", rank)
        ids = cut(numbered(ranked, "node_id", "kind_rank", "last_kmer", "strain"))
        inner_ids = ids.filter("kind_rank < 2").select("last_kmer", "node_id")
        end_ids = ids.filter("kind_rank = 2").select("strain", "node_id")
        places = ["node_id", "strain", "seg_ord", "seg_start", (F.col("seg_start") + F.length("omega")).alias("seg_end"), "last_kmer_pos", "kind"]
        ends_at = found.filter(F.col("kind") == END).join(end_ids, "strain").select(*places)
        self.node_occ = cut(inner.join(inner_ids, "last_kmer").select(*places).unionByName(ends_at))
        self._texts = ids.select("node_id", "kind", "omega", "multiplicity")

    @property
    def nodes(self) -> DataFrame:
        return self._texts.select("node_id", "kind", "omega", F.length("omega").cast("long").alias("len"), "multiplicity")

    @property
    def sizes(self) -> DataFrame:
        """node_id and len of all nodes; packed texts stay where they are."""
        return self.nodes.select("node_id", "len") if self._packed_texts is None else J.size_rows(self._packed_texts)

    @property
    def is_looked_through(self) -> bool:
        """Whether there are only nodes, packed, whose neighbours nodes_with() finds."""
        return self.node_occ is None

    def nodes_with(self, words: list[str], ends: list[str]) -> DataFrame:
        """node_id, omega, follows, holds and meets of the closed nodes that hold a word, or begin or end with one of ``ends`` (k - 1 bases):
        one look through the packed texts. An edge goes from a node to one that begins as it ends with a base that follows it."""
        return J.nodes_with(self._packed_texts, self.k, words, ends)

    @property
    def steps(self) -> DataFrame:
        """src, dst and strain of every step from a node occurrence to the next one."""
        here = self.node_occ.select("strain", "seg_ord", F.col("node_id").alias("src"))
        there = self.node_occ.select("strain", (F.col("seg_ord") - 1).alias("seg_ord"), F.col("node_id").alias("dst"))
        return here.join(there, ["strain", "seg_ord"]).select("strain", "src", "dst")

    @property
    def pairs(self) -> DataFrame:
        """src and dst of every edge, more than once where several strains have it; nothing is shuffled for it. Of nodes alone, those
        between closed nodes, by their ends."""
        if self.node_occ is None:
            ends = J.follow_rows(self._packed_texts, self.k)
            here = ends.select(F.col("node_id").alias("src"), F.col("last").alias("shared"), "follows")
            there = ends.select(F.col("node_id").alias("dst"), F.col("first").alias("shared"), "base")
            return here.join(there, "shared").filter(F.expr("shiftright(follows, base) & 1 = 1")).select("src", "dst")
        return self.steps.select("src", "dst") if self._cells is None else J.edge_rows(self._cells, None).select("src", "dst")

    @property
    def edges(self) -> DataFrame:
        if self._cells is None:
            return self.steps.groupBy("src", "dst", "strain").agg(F.count("*").alias("multiplicity"))
        # Only strains that lie in several cells have an edge's steps in several places.
        if not self._over:
            return J.edge_rows(self._cells, True)
        parts = J.edge_rows(self._cells, False).groupBy("src", "dst", "strain").agg(F.sum("multiplicity").alias("multiplicity"))
        return J.edge_rows(self._cells, True).unionByName(parts)

    def kmer_to_node(self) -> DataFrame:
        """kmer, node_id and offset: each k-mer that a closed node holds has one place in the graph."""
        inner = self.nodes.filter(F.col("kind") != END).select(F.col("node_id").alias("strain"), F.col("omega").alias("seq"), "len")
        return windows(inner, self.k).select(F.col("gram").alias("kmer"), F.col("strain").alias("node_id"), F.col("pos").alias("offset"))

    def neighbours(self, forward: bool) -> DataFrame:
        """node_id, character and neighbour: the base that the neighbour adds at the end (or start), "%" for end nodes."""
        k = self.k
        pairs = self.edges.select("src", "dst").distinct()
        here, there = ("src", "dst") if forward else ("dst", "src")
        texts = self.nodes.select(F.col("node_id").alias(there), "omega", "kind", "len")
        added = F.substring(F.col("omega"), k, 1) if forward else F.substring(F.col("omega"), F.greatest(F.col("len") - k + 1, F.lit(1)).cast("int"), F.lit(1))
        return pairs.join(texts, there).select(F.col(here).alias("node_id"), added.alias("character"), F.col(there).alias("neighbour"))

    def stats(self) -> DataFrame:
        """Counts, sums, means and medians of nodes and edges. Medians of an even count round the mean of the middle two down."""
        m, n = F.col("multiplicity"), F.col("len")
        return self.nodes.agg(
            F.count("*").alias("n_nodes"), F.sum(F.when(F.col("kind") != END, m).otherwise(0)).alias("n_edges"),
            F.sum(n).alias("total_len"), F.sum(m).alias("total_multiplicity"), (F.sum(n).cast("double") / F.count("*")).alias("mean_len"),
            (F.sum(m).cast("double") / F.count("*")).alias("mean_multiplicity"), F.floor(F.percentile(n, 0.5)).alias("median_len"),
            F.floor(F.percentile(m, 0.5)).alias("median_multiplicity"),
        )
