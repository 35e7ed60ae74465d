"""Matching reads to strains, exactly and with errors.

A read with at most k errors holds one of the exact seeds of a complete search scheme unchanged. Seeds are joined with
the strains' words of the same length (a handful of lengths, the longest that fits a seed), which gives places to
verify. Nothing is lost, whatever the scheme. Only reads with fewer bases than the scheme has parts have no seeds; they are
compared with every place of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panweave.functions.dna import hamming
from panweave.operators import schemes
from panweave.operators.ranking import cut, earlier, few_or_many
from panweave.operators.sequences import slices, windows

#: Lengths of words that seeds are cut to.
WORDS = (1, 2, 3, 4, 8, 12, 16, 20, 24)
#: Most errors that a mapper allows.
MOST_ERRORS = 5
METRICS = ("edit", "hamming")


def check_errors(k: int) -> None:
    if not 0 <= k <= MOST_ERRORS:
        raise ValueError(f"0 to {MOST_ERRORS} errors are allowed, not {k}")


def occurrences(reads: DataFrame, strains: DataFrame, k: int, metric: str = METRICS[0], scheme: str = schemes.DEFAULT) -> DataFrame:
    """Matches with at most k errors by this metric; exact ones for k = 0."""
    if metric not in METRICS:
        raise ValueError(f"the metric must be one of {', '.join(METRICS)}, not {metric}")
    check_errors(k)
    if k == 0:
        return exact_occurrences(reads, strains)
    return (edit_occurrences if metric == "edit" else hamming_occurrences)(reads, strains, k, scheme)


def exact_occurrences(reads: DataFrame, strains: DataFrame) -> DataFrame:
    """read_id, rc, strain, begin, len and ed = 0 of reads (read_id, rc, seq)."""
    hits = candidates(reads.filter("seq <> ''"), strains, 0, "pigeon")
    found = slices(hits.withColumn("size", F.length("seq")), strains, longest(reads))
    same = found.filter((F.col("text") == F.col("seq")))
    return same.select("read_id", "rc", "strain", "begin", F.length("seq").alias("length"), F.lit(0).alias("ed"), F.col("text").alias("matched"))


def longest(reads: DataFrame) -> int:
    return reads.agg(F.max(F.length("seq"))).first()[0] or 1


def spans_of(k: int, scheme: str, partition: str):
    """Column: the parts of a read; and the first and last part of each exact slice that a search begins with.

    A search that begins with an inexact part has no such slice; then the slices of the pigeonhole scheme serve."""
    chosen = [schemes.Search((0,), (0,), (0,))] if k == 0 else schemes.searches(scheme, k)
    begins = None
    if any(s.exact_parts == 0 for s in chosen):
        chosen = schemes.searches("pigeon", k)
    elif partition == "static" and k:
        begins = schemes.static_begins(scheme, k)
    parts = len(chosen[0].order)
    places = schemes.uniform_parts(F.length("seq"), parts) if begins is None else schemes.static_parts(F.length("seq"), begins)
    return places, sorted({(min(s.order[: s.exact_parts]), max(s.order[: s.exact_parts])) for s in chosen})


def seeds(reads: DataFrame, k: int, scheme: str = schemes.DEFAULT, *, partition: str = "uniform", most: int = WORDS[-1]) -> DataFrame:
    """read_id, rc, seq, offset, word: the exact slice of each search, cut to a length of WORDS, ``most`` at most."""
    places, spans = spans_of(k, scheme, partition)
    found = reads.withColumn("parts", places)
    slice_ = [F.struct(F.col("parts")[a]["begin"].alias("begin"), F.col("parts")[b]["end"].alias("end")) for a, b in spans]
    each = found.select("read_id", "rc", "seq", F.inline(F.array(*slice_)))
    n = F.col("end") - F.col("begin")
    size = reduce(lambda e, w: e.when(n >= w, w), sorted((w for w in WORDS if w <= most), reverse=True), F.when(F.lit(False), 0))
    word = F.substring(F.col("seq"), F.col("begin") + 1, F.col("size"))
    return each.withColumn("size", size).filter("size is not null").select("read_id", "rc", "seq", F.col("begin").alias("offset"), word.alias("word"))


def seedless(reads: DataFrame, k: int, scheme: str, partition: str = "uniform") -> tuple[DataFrame, DataFrame]:
    """The reads whose slices all have a base, and those with an empty one, which are too short for the scheme's parts."""
    places, spans = spans_of(k, scheme, partition)
    empty = reduce(lambda a, b: a | b, (F.col("parts")[b]["end"] <= F.col("parts")[a]["begin"] for a, b in spans))
    marked = reads.withColumn("parts", places).withColumn("seedless", empty)
    return marked.filter(~F.col("seedless")).select(*reads.columns), marked.filter("seedless and seq <> ''").select(*reads.columns)


def with_short(reads: DataFrame, k: int, scheme: str, partition: str, by_seeds, naively) -> DataFrame:
    """The matches of all reads: those without seeds are searched for naively."""
    long, short = seedless(reads, k, scheme, partition)
    return by_seeds(reads) if short.isEmpty() else by_seeds(long).unionByName(naively(short))


def seed_hits(reads: DataFrame, strains: DataFrame, k: int, scheme: str = schemes.DEFAULT, *, partition: str = "uniform") -> DataFrame:
    """Seeds with the strain and pos at which their words occur. One table of words for each length in use."""
    cut = seeds(reads, k, scheme, partition=partition)
    lengths = [r[0] for r in cut.select(F.length("word")).distinct().collect()]  # at most len(WORDS) numbers
    found = [windows(strains, w).withColumnRenamed("gram", "word").join(few_or_many(cut.filter(F.length("word") == w)), "word") for w in sorted(lengths)]
    if not found:
        return cut.join(windows(strains, WORDS[0]).withColumnRenamed("gram", "word"), "word")
    return reduce(DataFrame.unionByName, found)


def candidates(reads: DataFrame, strains: DataFrame, k: int, scheme: str = schemes.DEFAULT, *, partition: str = "uniform") -> DataFrame:
    """Distinct read_id, rc, seq, strain, begin at which a read may lie without insertions and deletions."""
    hits = seed_hits(reads, strains, k, scheme, partition=partition)
    return hits.select("read_id", "rc", "seq", "strain", (F.col("pos") - F.col("offset")).alias("begin")).distinct()


def hamming_occurrences(reads: DataFrame, strains: DataFrame, k: int, scheme: str = schemes.DEFAULT) -> DataFrame:
    """read_id, rc, strain, begin, length, ed of all places that differ in at most k bases."""
    check_errors(k)

    def alike(near: DataFrame) -> DataFrame:
        found = slices(near.filter("begin >= 0").withColumn("size", F.length("seq")), strains, longest(reads)).filter(F.length("text") == F.length("seq"))
        return found.withColumn("ed", hamming(F.col("text"), F.col("seq"))).filter(F.col("ed") <= k).select("read_id", "rc", "strain", "begin", F.length("seq").alias("length"), "ed", F.col("text").alias("matched"))

    return with_short(reads, k, scheme, "uniform", lambda r: alike(candidates(r, strains, k, scheme)), lambda r: alike(all_places(r, strains, k)))


def edit_occurrences(reads: DataFrame, strains: DataFrame, k: int, scheme: str = schemes.DEFAULT, *, partition: str = "uniform") -> DataFrame:
    """read_id, rc, strain, begin, length, ed of all substrings of strains within edit distance k."""
    check_errors(k)

    def by_seeds(r: DataFrame) -> DataFrame:
        near = shifted(candidates(r, strains, k, scheme, partition=partition), k)
        return verified(slices(near.filter("begin >= 0").distinct().withColumn("size", F.length("seq") + k), strains, longest(reads) + k), k)

    return with_short(reads, k, scheme, partition, by_seeds, lambda r: naive_edit_occurrences(r, strains, k))


def shifted(near: DataFrame, k: int) -> DataFrame:
    """Candidates with their begins moved by up to k bases either way."""
    moved = near.select("read_id", "rc", "seq", "strain", "begin", F.explode(F.sequence(F.lit(-k), F.lit(k))).alias("shift"))
    return moved.select("read_id", "rc", "seq", "strain", (F.col("begin") + F.col("shift")).alias("begin"))


def verified(found: DataFrame, k: int) -> DataFrame:
    """Of the texts at candidate places, all prefixes within edit distance k of the read."""
    each = found.select("*", F.explode(F.sequence(F.greatest(F.length("seq") - k, F.lit(1)), F.length("seq") + k)).alias("length")).filter(F.length("text") >= F.col("length"))
    each = each.withColumn("matched", F.substring(F.col("text"), F.lit(1), F.col("length"))).withColumn("ed", F.levenshtein("matched", "seq", k))
    return each.filter("ed >= 0").select("read_id", "rc", "strain", "begin", "length", "ed", "matched")


def all_places(reads: DataFrame, strains: DataFrame, k: int) -> DataFrame:
    """Distinct read_id, rc, seq, strain, begin of every place, for few short reads; words of one base keep the join keyed."""
    # With at most k errors, one of the first k + 1 bases is unchanged; a read without that many may change wholly.
    long = reads.filter(F.length("seq") > k).select("read_id", "rc", "seq", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("offset"))
    keyed = long.withColumn("word", F.substring(F.col("seq"), F.col("offset") + 1, F.lit(1)))
    tiny = reads.filter(F.length("seq").between(1, k)).select("read_id", "rc", "seq", F.lit(0).alias("offset"), F.explode(F.array(*map(F.lit, "ACGT"))).alias("word"))
    hits = keyed.unionByName(tiny).join(windows(strains, 1).withColumnRenamed("gram", "word"), "word")
    return hits.select("read_id", "rc", "seq", "strain", (F.col("pos") - F.col("offset")).alias("begin")).distinct()


def naive_edit_occurrences(reads: DataFrame, strains: DataFrame, k: int) -> DataFrame:
    """edit_occurrences() by trying every place; for reads too short for seeds. Few such reads are meant."""
    check_errors(k)
    near = shifted(all_places(reads, strains, k), k)
    near = near.filter("begin >= 0").distinct().withColumn("size", F.length("seq") + k)
    return verified(slices(near, strains, longest(reads) + k), k)


def cigar(matched: str, seq: str) -> str:
    """How a read is made from the text that it matches: "=" equal, "X" other, "I" a base of the read alone, "D" one of the text alone.

    Of the cheapest ways, from the end on: along both if that is cheapest, else the read's base alone."""
    rows = [list(range(len(seq) + 1))]
    for i, x in enumerate(matched):
        up = rows[-1]
        row = [i + 1]
        for j, y in enumerate(seq):
            row.append(min(up[j] + (x != y), up[j + 1] + 1, row[j] + 1))
        rows.append(row)
    i, j, out = len(matched), len(seq), []
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (matched[i - 1] != seq[j - 1]):
            i, j = i - 1, j - 1
            out.append("=" if matched[i] == seq[j] else "X")
        elif j and rows[i][j] == rows[i][j - 1] + 1:
            j -= 1
            out.append("I")
        else:
            i -= 1
            out.append("D")
    return "".join(f"{len(list(run))}{op}" for op, run in groupby(reversed(out)))


def with_cigars(found: DataFrame, reads: DataFrame) -> DataFrame:
    """Matches (with matched) with cigar."""

    columns = [*(c for c in found.columns if c != "matched"), "matched"]
    schema = StructType([*(found.schema[c] for c in columns), StructField("cigar", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, seqs = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
            made = pa.array([cigar(a, b) for a, b in zip(texts, seqs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*columns, "cigar"])

    return found.join(reads.select("read_id", "rc", "seq"), ["read_id", "rc"]).select(*columns, "seq").mapInArrow(run, schema)


def best_per_begin(found: DataFrame) -> DataFrame:
    """Of the matches with one begin, the one with fewest errors, then the shortest."""
    best = found.groupBy("read_id", "rc", "strain", "begin").agg(F.min(F.struct("ed", "length", "matched")).alias("best"))
    return best.select("read_id", "rc", "strain", "begin", F.col("best.length").alias("length"), F.col("best.ed").alias("ed"), F.col("best.matched").alias("matched"))


def fold(items, k: int):
    """Column: sorted (position, ed, length, ...) without those that lie within 2k of the last one kept, unless
    they are better, when they take its place."""

    def step(kept, x):
        last = F.element_at(kept, -1)
        better = (x["ed"] < last["ed"]) | ((x["ed"] == last["ed"]) & (x["length"] < last["length"]))
        near = F.when(better, F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)
        return F.when(F.size(kept) == 0, F.array(x)).when(x["position"] - last["position"] <= 2 * k, near).otherwise(F.concat(kept, F.array(x)))

    return step


def dedup_positions(found: DataFrame, starts: DataFrame, k: int) -> DataFrame:
    """Matches at text positions, best per begin, without those made redundant by a better one near.

    starts: strain and start. A read whose matches all are one and the same string keeps them all. Where neighbours are more
    than 2k apart, what came before doesn't matter; so only runs of close matches, never all of a read, meet in an array."""
    keys = ["read_id", "rc"]
    best = found.groupBy(*keys, "strain", "begin").agg(F.min(F.struct("ed", "length", "matched")).alias("best"), F.min("matched").alias("m0"), F.max("matched").alias("m1"))
    placed = best.join(starts.select("strain", "start"), "strain").select(*keys, "strain", "begin", (F.col("start") + F.col("begin")).alias("position"), "best.ed", "best.length", "m0", "m1")
    placed = cut(placed)
    strings = few_or_many(placed.groupBy(*keys).agg(F.min("m0").alias("m0"), F.max("m1").alias("m1")))
    apart = F.coalesce(F.col("position") - F.col("_last") > 2 * k, F.lit(True))
    opened = cut(earlier(placed.drop("m0", "m1"), keys, "position", "position").withColumn("run", F.when(apart, F.col("position"))).drop("_last", "_before"))
    runs = earlier(opened, keys, "position", "run").withColumn("run", F.coalesce("run", "_last"))
    item = F.struct("position", "ed", "length", "strain", "begin")
    groups = runs.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(item)).alias("items")).join(strings, keys)
    empty = F.slice("items", 1, 0)
    kept = F.when(F.col("m0") == F.col("m1"), F.col("items")).otherwise(F.aggregate("items", empty, fold("items", k)))
    return groups.select("read_id", "rc", F.inline(kept)).select("read_id", "rc", "strain", "begin", "position", "length", "ed")


def report(reads: DataFrame, matches: DataFrame, paths: DataFrame) -> DataFrame:
    """One row: reads, mapped reads, matches, node paths and their means, and the median of matches for each read."""
    each = matches.groupBy("read_id").agg(F.count("*").alias("n"))
    ways = paths.select("read_id", "rc", "path").distinct().groupBy("read_id").agg(F.count("*").alias("p"))
    all_reads = reads.select("read_id").distinct().join(each, "read_id", "left").join(ways, "read_id", "left").na.fill(0, ["n", "p"])
    return all_reads.agg(
        F.count("*").alias("n_reads"), F.sum((F.col("n") > 0).cast("long")).alias("n_mapped"), F.sum("n").alias("n_matches"), F.sum("p").alias("n_paths"),
        (F.sum("n").cast("double") / F.count("*")).alias("mean_matches"), (F.sum("p").cast("double") / F.count("*")).alias("mean_paths"), F.percentile("n", 0.5).alias("median_matches"),
    )
