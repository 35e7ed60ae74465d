"""Line dedup by pairwise alignment.

A later document is aligned with an earlier one if they share a rare line, one that at most RARE documents hold, or a window:
from each line on, and up to each line, the fewest lines of at least BLOCK_WORDS words. Windows are never too frequent,
so large groups of copies aren't lost. Each line and window is looked up by hash, and its earliest holder is the document
to align with; so a passage that a third of all documents hold makes a row for each of them and no pairs among them.

Alignment is patience diff: lines that occur once in either document are matched along the longest increasing chain; between
its links the same goes on with what is left there; where no line occurs once, all lines that the two share are taken. Then the
lines that are left over are aligned likewise, so that moved blocks are found, too. Runs of neighbouring matches are blocks;
those of at least BLOCK_WORDS words are deleted from the later document. A passage that alignment left, as the earlier document
repeats its lines elsewhere, goes by its windows. So of every document exactly those lines go that lie in a run of lines
of BLOCK_WORDS words or more which an earlier document has: the earliest holder of each window tells whether one has it.

Lines are compared by 128-bit hashes of their text without white space at the ends. Earlier means smaller doc_id.

Defined cases: null and empty texts have no lines and stay as they are; blank lines are never deleted, unless
nothing else is left, which makes the text empty. Empty tables give empty results. Repeated rows (same id and
text) are one document and get the same edit. Rows with one id and different texts are different documents,
ordered by a hash. A null id is smaller than all others. Extra columns are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panweave.llm.common import column, cut, doc_rank, free_name, sliced, stored

#: Words of a block, and the most documents that hold a rare line.
BLOCK_WORDS, RARE = 20, 256
#: Hashes of windows are of another kind than those of lines, whose seed is a line's number.
WINDOW_SEED = 2**64 - 1
KEY = "doc_rank long, text_key long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_rank (the id; below all ids for null) and text_key beside the text."""
    text = F.col("text").cast("string")
    return docs.select(doc_rank(F.col("doc_id")).alias("doc_rank"), text_key(text).alias("text_key"), text.alias("text"))


def text_key(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(text: str | None) -> list[tuple[int, int, int, int]]:
    """Of each line with words: two halves of its hash, which also tells repeated lines apart, its words, and whether it
    occurs only once (0) or again (-1)."""
    kept = [line for line in (x.strip() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if line]
    total, seen = Counter(kept), Counter()
    out = []
    for line in kept:
        h = xxhash.xxh3_128_intdigest(line, seen[line])
        seen[line] += 1
        out.append(((h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, len(line.split()), 0 if total[line] == 1 else -1))
    return out


def windows(n_words: list[int]) -> list[tuple[int, int]]:
    """First and last line of the shortest runs of at least BLOCK_WORDS words from each line on and up to each line."""
    found = set()
    first = words = 0
    for last, n in enumerate(n_words):  # up to each line
        words += n
        while words - n_words[first] >= BLOCK_WORDS:
            words -= n_words[first]
            first += 1
        if words >= BLOCK_WORDS:
            found.add((first, last))
    last, words = len(n_words) - 1, 0
    for first in range(len(n_words) - 1, -1, -1):  # from each line on
        words += n_words[first]
        while words - n_words[last] >= BLOCK_WORDS:
            words -= n_words[last]
            last -= 1
        if words >= BLOCK_WORDS:
            found.add((first, last))
    return sorted(found)


def window_hashes(text: str | None) -> list[tuple[int, int, int, int, int]]:
    """Of each window: its first line, two halves of the hash of its lines, its words and its lines."""
    kept = [line for line in (x.strip() for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n")) if line]
    n_words = [len(line.split()) for line in kept]
    out = []
    for first, last in windows(n_words):
        h = xxhash.xxh3_128_intdigest(b"\n".join(kept[first : last + 1]), WINDOW_SEED)
        out.append((first, (h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, sum(n_words[first : last + 1]), last - first + 1))
    return out


def lines(docs: DataFrame) -> DataFrame:
    """doc_rank, text_key, place (from 0), h1, h2, n_words, n_lines of every line with words (n_lines 0, or -1 if it occurs again in its text) and of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [(r, k, *x) for r, k, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for x in [*((i, *y) for i, y in enumerate(line_hashes(t))), *window_hashes(t)]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_rank", "text_key", "place", "h1", "h2", "n_words", "n_lines"])

    return keyed(docs).mapInArrow(run, KEY + ", place int, h1 long, h2 long, n_words int, n_lines int")


def longest_chain(places: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, x in enumerate(places):
        pile = bisect_left(tops, x)
        before.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[pile], at[pile] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(pairs: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """Matched places (here, there) of two documents, rising in both, of their pairs of equal lines.

    pairs: place here, place there, and whether the line occurs once in either document."""
    out, waiting = [], [sorted(pairs)]
    while waiting:
        left = waiting.pop()
        anchors = [x for x in left if x[2]] or left
        picked = chain_of(anchors)
        out += [x[:2] for x in picked]
        if anchors is left:
            continue
        # What lies between two neighbouring anchors, in both documents.
        ends = [(-1, -1), *(x[:2] for x in picked), (1 << 62, 1 << 62)]
        at = 0
        for (a, b), (c, d) in zip(ends, ends[1:], strict=False):
            while at < len(left) and left[at][0] <= a:
                at += 1
            between = []
            while at < len(left) and left[at][0] < c:
                if b < left[at][1] < d:
                    between.append(left[at])
                at += 1
            if between:
                waiting.append(between)
    return sorted(out)


def chain_of(pairs: list[tuple]) -> list[tuple]:
    """The longest chain of pairs that rises in both places. Of pairs with one place here, one at most is taken."""
    ordered = sorted(pairs, key=lambda x: (x[0], -x[1]))
    return [ordered[i] for i in longest_chain([x[1] for x in ordered])]


def align(shared: list[tuple]) -> tuple[set[int], set[int]]:
    """Places of the lines to delete, and the ranks of the documents they were aligned with.

    shared: (place, n_words, owner's rank, owner's text key, place there, n_lines, owner's n_lines, rare) of the document's
    lines and windows that an earlier document holds."""
    words = {x[0]: x[1] for x in shared if x[5] <= 0}
    single = {x[0] for x in shared if x[5] == 0}
    by_owner: dict[tuple, dict] = defaultdict(dict)
    wanted = set()
    for place, _, rank, key, there, n_lines, their_lines, rare in shared:
        pairs = by_owner[rank, key]
        if n_lines <= 0:
            pairs[place, there] = n_lines == 0 and their_lines == 0
        for i in range(max(n_lines, 0)):
            pairs.setdefault((place + i, there + i), False)
        if rare or n_lines > 0:
            wanted.add((rank, key))
    gone: set[int] = set()
    sources = set()
    for owner in sorted(wanted):
        known = by_owner[owner]
        theirs = Counter(there for _, there in known)
        here = Counter(place for place, _ in known)
        left = [(a, b, once or (a in single and here[a] == 1 and theirs[b] == 1)) for (a, b), once in known.items()]
        while left:
            matched = patience(left)
            for block in blocks_of(matched):
                # The number of a repeated line may be new, then its words aren't known here and its windows decide.
                if sum(words.get(a, 0) for a, _ in block) >= BLOCK_WORDS:
                    gone.update(a for a, _ in block)
                    sources.add(owner[0])
            done, there = {a for a, _ in matched}, {b for _, b in matched}
            left = [x for x in left if x[0] not in done and x[1] not in there]
    return gone, sources


def blocks_of(matched: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Runs of matches that are neighbours in both documents."""
    out: list[list[tuple[int, int]]] = []
    for a, b in matched:
        if out and out[-1][-1] == (a - 1, b - 1):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
    return out


def to_delete(shared: list[tuple]) -> tuple[list[int], list[int]]:
    """The same, sorted, with the lines of windows that alignment left."""
    gone, sources = align(shared)
    for place, _, owner, _, _, n_lines, _, _ in shared:
        if n_lines > 0 and not gone.issuperset(range(place, place + n_lines)):
            gone.update(range(place, place + n_lines))
            sources.add(owner)
    return sorted(gone), sorted(sources)


def deletions(docs: DataFrame) -> DataFrame:
    """doc_rank, text_key, gone (places of deleted lines among those with words) and sources of the documents that lose lines."""
    found = stored(lines(docs), "lines")
    owner = F.struct("doc_rank", "text_key", "place", "n_lines")
    owners = found.groupBy("h1", "h2").agg(F.min(owner).alias("o"), F.max(F.struct("doc_rank", "text_key")).alias("last"), F.count("*").alias("n"))
    # Only lines and windows that at least two documents hold.
    owners = owners.filter((F.col("o.doc_rank") != F.col("last.doc_rank")) | (F.col("o.text_key") != F.col("last.text_key")))
    owners = owners.select("h1", "h2", F.col("o.doc_rank").alias("o_rank"), F.col("o.text_key").alias("o_key"), F.col("o.place").alias("o_place"), F.col("o.n_lines").alias("o_lines"), (F.col("n") <= RARE).alias("rare"))
    owners = cut(owners)  # so that both sides of the join are dealt by it alone, and a hot line's part can be split
    later = (F.col("doc_rank") != F.col("o_rank")) | (F.col("text_key") != F.col("o_key"))
    shared = found.join(owners, ["h1", "h2"]).filter(later)
    each = shared.groupBy("doc_rank", "text_key").agg(
        F.collect_set(F.struct("place", "n_words", "o_rank", "o_key", "o_place", "n_lines", "o_lines", "rare")).alias("shared"), F.max("n_lines").alias("window"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [to_delete([tuple(x.values()) for x in rows]) for rows in batch.column(2).to_pylist()]
            arrays = [pa.array([g for g, _ in made], pa.list_(pa.int32())), pa.array([s for _, s in made], pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["doc_rank", "text_key", "gone", "sources"])
            yield out.filter(pa.array([bool(g) for g, _ in made], pa.bool_()))

    # A block of BLOCK_WORDS words has a window, so other documents lose nothing.
    return each.filter("window > 0").select("doc_rank", "text_key", "shared").mapInArrow(run, KEY + ", gone array<int>, sources array<long>")


def without(text: str, gone: list[int]) -> str:
    """The text without these of its lines with words."""
    drop, kept, place, words = set(gone), [], 0, False
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").strip():
            if place not in drop:
                kept.append(line)
                words = True
            place += 1
        else:
            kept.append(line)
    return "\n".join(kept) if words else ""


def edited(docs: DataFrame, *extra: str) -> DataFrame:
    """All rows and columns of ``docs`` with the edited text; ``extra`` of gone and sources under free names at the end."""
    names = {x: free_name(docs, f"line_dedup_{x}") for x in ("doc_rank", "text_key", "gone", "sources")}
    # The lists are the small side: texts are dealt by hash and stream past them, and are never sorted.
    lost = cut(deletions(docs).toDF(*names.values())).hint("shuffle_hash")
    rank, key = doc_rank(column(docs, "doc_id")), text_key(column(docs, "text").cast("string"))
    joined = docs.withColumns({names["doc_rank"]: rank, names["text_key"]: key}).join(lost, [names["doc_rank"], names["text_key"]], "left")
    joined = joined.select(*(column(joined, c) for c in docs.columns), names["gone"], names["sources"])
    at, n = docs.columns.index("text"), len(docs.columns)
    fields = joined.schema.fields[:n] + [joined.schema[names[x]] for x in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [batch.column(i) for i in range(n)]
            hit = batch.column(n).is_valid()  # only these texts become Python objects
            pairs = zip(columns[at].filter(hit).to_pylist(), batch.column(n).filter(hit).to_pylist(), strict=True)
            columns[at] = pc.replace_with_mask(columns[at], hit, pa.array([without(t, g) for t, g in pairs], columns[at].type))
            columns += [batch.column(n + ("gone", "sources").index(x)) for x in extra]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return joined.mapInArrow(run, StructType(fields))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines deleted that earlier documents have in aligned blocks."""
    return edited(docs)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed (places among lines with words), sources (ids aligned with), n_chars and sha256 of what stays."""
    out = edited(docs.select("doc_id", "text"), "gone", "sources").toDF("doc_id", "text", "gone", "sources")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<int>")
    return out.select(
        "doc_id", F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.coalesce("gone", none).alias("removed"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("left_sha256"),
    )
