"""Relational views of a text index: suffix array, Burrows-Wheeler transform and what follows from them.

The text is kept in blocks of 16 KB, so no row and no join carries a whole strain. Suffixes are sorted by growing prefixes:
ranks by the first n characters give ranks by eight times as many. After each step only the suffixes that still share a rank are
ranked anew, so a step costs what is left over. Ranks are numbered by range partitions, so no step sorts all rows in one
task. These views show the index; matching doesn't use them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panweave.operators.ranking import all_prefix_sums, cut, few_or_many, numbered, prefix_sums
from panweave.operators.sequences import BLOCK

#: Characters that the first ranks compare: as many as fit a number, three bits each.
FIRST = 21
#: By how much a step lengthens what ranks compare: fewer steps for more places to look up in each.
GROWTH = 8
#: All characters in order.
LETTERS = "$%ACGT"


def text_blocks(texts: DataFrame, *, order: str = "strain", text: str = "seq") -> DataFrame:
    """block and chunk: the whole text (every row's text, "%" between, "$" at the end) in pieces of ``BLOCK`` characters.

    ``order`` must be a key; rows of empty or null texts count for nothing."""
    rows = texts.select(F.col(order).alias("strain"), F.col(text).alias("seq"), F.length(text).cast("long").alias("len")).filter("len > 0")
    sizes = numbered(rows.select("strain", "len", (F.col("len") + 1).alias("_size")), "_number", "strain")
    starts = few_or_many(prefix_sums(sizes, "_size", "_number").select("strain", F.col("before").alias("start")))
    last = starts.agg(F.max("strain").alias("last"))
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(BLOCK).cast("long")))
    cuts = rows.select("strain", "len", F.col("seq").cast("binary").alias("seq"), begin.alias("at"))
    piece = F.substring("seq", (F.col("at") + 1).cast("int"), F.lit(BLOCK)).cast("string")
    mark = F.when(F.col("at") + BLOCK < F.col("len"), "").when(F.col("strain") == F.col("last"), "$").otherwise("%")
    pieces = cuts.select("strain", "len", "at", piece.alias("piece")).join(starts, "strain").crossJoin(F.broadcast(last))  # one row
    placed = pieces.select((F.col("start") + F.col("at")).alias("at"), F.concat("piece", mark).alias("piece"))
    # A piece and its end mark may lie across two blocks; a piece of one character more than a block ends in one of them.
    first = F.col("at") - F.col("at") % BLOCK
    touched = placed.select("at", "piece", F.explode(F.sequence(first, F.col("at") + F.length("piece") - 1, F.lit(BLOCK).cast("long"))).alias("from"))
    lead = F.greatest(F.col("from") - F.col("at"), F.lit(0))
    part = F.expr("substring(piece, cast(greatest(`from` - at, 0) + 1 as int), cast(`from` + {0} - greatest(at, `from`) as int))".format(BLOCK))
    parts = touched.select((F.col("from") / BLOCK).cast("long").alias("block"), F.struct((F.col("at") + lead).alias("at"), part.alias("s")).alias("part"))
    # A block has at most as many parts as characters.
    return parts.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["s"]), "").alias("chunk"))


def characters(blocks: DataFrame) -> DataFrame:
    """pos and ch of the whole text."""
    each = blocks.select("block", F.posexplode(F.split("chunk", "")).alias("i", "ch")).filter("ch <> ''")
    return each.select((F.col("block") * BLOCK + F.col("i")).alias("pos"), "ch")


def grams(blocks: DataFrame, width: int) -> DataFrame:
    """pos and gram: the characters from each position on, fewer at the end. A block needs only the head of the next one."""
    heads = blocks.select((F.col("block") - 1).alias("block"), F.substring("chunk", 1, width - 1).alias("head"))
    whole = blocks.join(heads, "block", "left").select("block", F.length("chunk").alias("n"), F.concat("chunk", F.coalesce("head", F.lit(""))).cast("binary").alias("bytes"))
    each = whole.select("block", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return each.select((F.col("block") * BLOCK + F.col("i")).alias("pos"), F.substring("bytes", F.col("i") + 1, F.lit(width)).cast("string").alias("gram"))


def suffix_array(blocks: DataFrame) -> DataFrame:
    """row and pos of every suffix in sorted order. The final "$" is smaller than all other characters."""
    digits = F.rpad(F.translate("gram", LETTERS, "123456"), FIRST, "0")
    state = cut(ranked(cut(grams(blocks, FIRST).select("pos", F.conv(digits, 8, 10).cast("long").alias("key"))), ["key"]))
    tied, step = shared(state), FIRST
    while not tied.isEmpty():
        i = F.explode(F.sequence(F.lit(1), F.lit(GROWTH - 1))).alias("i")
        asked = tied.select("pos", "rank", i).withColumn("at", F.col("pos") + F.col("i") * step)
        met = asked.join(state.select(F.col("pos").alias("at"), F.col("rank").alias("next")), "at", "left")
        # Places past the end are smaller than all others.
        each = [F.coalesce(F.max(F.when(F.col("i") == i, F.col("next"))), F.lit(-1)).alias(f"next{i}") for i in range(1, GROWTH)]
        fresh = cut(refined(cut(met.groupBy("pos", "rank").agg(*each))))
        state = cut(state.join(fresh.withColumnRenamed("rank", "fresh"), "pos", "left").select("pos", F.coalesce("fresh", "rank").alias("rank")))
        tied, step = shared(fresh), step * GROWTH
    return state.select(F.col("rank").alias("row"), "pos")


def shared(state: DataFrame) -> DataFrame:
    """The rows whose rank others have, too."""
    ranks = few_or_many(state.groupBy("rank").agg(F.count("*").alias("n")).filter("n > 1").select("rank"))
    return cut(state.join(ranks, "rank"))


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with rank: how many rows have a smaller key."""
    counts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    order = numbered(counts, "place", *key)
    return rows.join(cut(prefix_sums(order, "n", "place").select(*key, F.col("before").alias("rank"))), key).select("pos", "rank")


def refined(rows: DataFrame) -> DataFrame:
    """pos and rank by all columns after pos, of rows that share ranks: the rank, and how many of its rows have a smaller key."""
    key = rows.columns[1:]
    sums = cut(prefix_sums(numbered(rows.groupBy(*key).agg(F.count("*").alias("n")), "place", *key), "n", "place").select(*key, "before"))
    # Both sides of these joins are stored, so what a rank of very many rows gets can be split.
    first = few_or_many(sums.groupBy("rank").agg(F.min("before").alias("first")))
    fresh = cut(sums.join(first, "rank").select(*key, (F.col("rank") + F.col("before") - F.col("first")).alias("fresh")))
    return rows.join(fresh, key).select("pos", F.col("fresh").alias("rank"))


def bwt(array: DataFrame, chars: DataFrame) -> DataFrame:
    """row and ch: the character before each suffix; before the first one, the last of the text."""
    n = chars.agg(F.count("*").alias("n"))
    before = array.crossJoin(F.broadcast(n)).select("row", F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"))
    return before.join(chars, "pos").select("row", "ch")


def counted_above(transform: DataFrame) -> DataFrame:
    """row, ch and, for each character, how often it stands in the rows above: one pass for all of them."""
    return all_prefix_sums(transform.select("row", "ch"), {f"n{ord(c)}": (F.col("ch") == c).cast("long") for c in LETTERS}, "row")


def occurrences(transform: DataFrame) -> DataFrame:
    """row, ch and occ: how often the row's character stands in the rows above it."""
    own = F.coalesce(*(F.when(F.col("ch") == c, F.col(f"n{ord(c)}")) for c in LETTERS))
    return counted_above(transform).select("row", "ch", own.alias("occ"))


def last_to_first(transform: DataFrame) -> DataFrame:
    """row and lf: the row of the suffix that is one character longer."""
    occ = occurrences(transform)
    counts = transform.groupBy("ch").agg(F.count("*").alias("n"))  # six rows at most
    smaller = counts.select("ch", F.coalesce(F.sum("n").over(Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller"))
    return occ.join(F.broadcast(smaller), "ch").select("row", (F.col("smaller") + F.col("occ")).alias("lf"))


def lcp_classes(array: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """row and class: whether a suffix shares fewer than k (0), exactly k (1) or more (2) characters with the one before it."""
    grams = texts.select("pos", "gram")  # the first k + 1 characters from each position
    rows = array.join(grams, "pos").select("row", "gram")
    previous = rows.select((F.col("row") + 1).alias("row"), F.col("gram").alias("above"))
    same = lambda n: F.substring("gram", 1, n) == F.substring("above", 1, n)
    both = rows.join(previous, "row", "left")
    return both.select("row", F.when(F.col("above").isNull(), 0).when(same(k + 1), 2).when(same(k), 1).otherwise(0).alias("class"))


def rank_table(transform: DataFrame) -> DataFrame:
    """row, ch, occ and cum_occ for every row and each of the six characters: how often the character, and how often smaller
    ones, stand in the rows above."""
    each = []
    for i, c in enumerate(LETTERS):
        smaller = sum((F.col(f"n{ord(x)}") for x in LETTERS[:i]), F.lit(0).cast("long"))
        each.append(F.struct(F.lit(c).alias("ch"), F.col(f"n{ord(c)}").alias("occ"), smaller.alias("cum_occ")))
    return counted_above(transform).select("row", F.inline(F.array(*each)))


def find_positions(rows: DataFrame, lf: DataFrame, sparse: DataFrame, factor: int) -> DataFrame:
    """row and pos of the rows asked for, by walking to the row of the suffix that is one longer until a sampled one is met.

    sparse: row and pos of the suffixes whose place is a multiple of ``factor``, so a walk has fewer steps than that."""
    step = lf.select(F.col("row").alias("at"), F.col("lf").alias("next"))
    known = sparse.select(F.col("row").alias("at"), F.col("pos").alias("found"))
    left, out = rows.select("row", F.col("row").alias("at")), None
    for walked in range(factor):
        met = cut(left.join(known, "at", "left"))
        done = met.filter("found is not null").select("row", (F.col("found") + walked).alias("pos"))
        out = done if out is None else out.unionByName(done)
        left = met.filter("found is null").join(step, "at").select("row", F.col("next").alias("at"))
    return out


def check_index(chars: DataFrame, array: DataFrame) -> None:
    """Raises ValueError unless the text ends in "$", which stands nowhere else, and the array holds every place once."""
    text = chars.agg(F.count("*").alias("n"), F.max_by("ch", "pos").alias("last"), F.sum((F.col("ch") == "$").cast("long")).alias("ends")).first()
    if not text["n"] or text["last"] != "$" or text["ends"] != 1:
        raise ValueError("the text must end in $, and hold it only there")
    rows = array.agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).first()
    if rows["n"] != text["n"]:
        raise ValueError("text and suffix array differ in length")
    if (rows["low"], rows["high"]) != (0, text["n"] - 1) or array.select("pos").distinct().count() != text["n"]:
        raise ValueError("the suffix array must hold every place of the text once")
