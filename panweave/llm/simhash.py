"""SimHash near-duplicates.

The fingerprint of a text has a bit for each of 64 positions, set if more than half of its shingles' hashes have
it. Fingerprints within DISTANCE bits are linked. Pigeonhole: of some blocks all but DISTANCE at least are
equal, so distinct fingerprints are keyed by each choice of that many blocks, and those under one key are
compared. The more fingerprints there are, the more blocks, and so the longer keys, are used: their number is counted first. Rows under one key arrive sorted, in bounded portions; a key yields one link for each member of a
cluster, not all pairs. Fingerprints under a key with more than CROWD of them are handed on and linked exactly
by another use of the same principle: two fingerprints within four bits are both within two bits of a common
word, so each is keyed by all words within two bits and linked to the first under the same word.

drop_near_duplicates() is for whole texts: five-word shingles and a set similarity of 0.8 or more. At 0.8, fingerprints
of 64 bits differ in ten bits or so, and no choice of blocks is both sure and selective there. So its candidates
also come from bands of minwise hashes; every candidate pair is then held against the exact similarity of the
shingle sets. Members of a band, or of a group of close fingerprints, that this doesn't link are searched for further
pairs by an exact prefix filter.

Defined cases: a null text counts as empty; texts without words have the fingerprint zero, and are linked like
any others. Empty tables give empty results. Repeated rows have one fingerprint and one component; where one of
each group stays, one row of them stays. Ties go to the smallest doc_id; a null doc_id is never the smallest
in op9's component_id, and counts as smaller than all ids in drop_near_duplicates(). There, rows of one id, or of none, and
different texts are different documents: only equal and similar texts are dropped. Extra columns are kept there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panweave.llm.common import column, cut, doc_rank, free_name, map_texts, stored
from panweave.llm.components import components

SEED, SHINGLE, DISTANCE, CROWD = 42, 4, 4, 512
#: Fewest and most blocks, and how many fingerprints may share a key by chance.
LEAST_BLOCKS, MOST_BLOCKS, BY_CHANCE = 5, 10, 32
NEAR_SHINGLE, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 20, 5
PORTION = 1 << 15
#: Cells that count shingles; rows of a group that are paired by shifting; pairs that are tried at a time.
CELLS, FEW, CHUNK = 1 << 18, 64, 1 << 20


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's runs of ``size`` words, repeats included; of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), int, len(words)) + 1)
    begins = np.concatenate([[0], ends[: len(words) - size]]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(begins, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, as a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PORTION):
        part = hashes[at : at + PORTION].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id and fp (long) of every document."""
    return map_texts(docs, lambda texts: [pa.array([fingerprint(shingle_hashes(x, size)) for x in texts], pa.int64())], "fp long")


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """The fewest blocks of which few of n random fingerprints share a key. Any number is right; this one makes few rows."""
    for blocks in range(LEAST_BLOCKS, MOST_BLOCKS):
        if n <= BY_CHANCE << 64 * (blocks - distance) // blocks:
            return blocks
    return MOST_BLOCKS


def block_masks(blocks: int, equal: int) -> list[int]:
    """Masks (signed) of every choice of ``equal`` of ``blocks`` blocks of the 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(block, equal)]
    return [m - 2**64 if m >= 2**63 else m for m in masks]


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which signed numbers differ."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def cluster(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """One link for each member but the first of every cluster of a few fingerprints."""
    near = apart(fps[:, None], fps[None, :]) <= distance
    label = np.arange(len(fps))
    while True:
        lower = np.where(near, label[None, :], len(fps)).min(1)
        if (lower == label).all():
            break
        label = lower
    return [(int(fps[i]), int(fps[j])) for i, j in enumerate(label.tolist()) if i != j]


def link_sorted(batches: Iterator[pa.RecordBatch], distance: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) among rows (combo, masked, fp) sorted by the first two, and (a, null) for members of crowds."""
    rest = np.empty((3, 0), np.int64)
    crowded: tuple | None = None  # the key that has already been found too large

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        nonlocal crowded
        a: list[int] = []
        b: list[int | None] = []
        if rows.shape[1]:
            change = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])) + 1
            begins, ends = np.concatenate([[0], change]), np.concatenate([change, [rows.shape[1]]])
            sizes = ends - begins
            known = np.zeros(len(sizes), bool)
            known[0] = crowded is not None and (rows[0, 0], rows[1, 0]) == crowded
            pairs = begins[(sizes == 2) & ~known]
            near = pairs[apart(rows[2, pairs], rows[2, pairs + 1]) <= distance]
            a += rows[2, near + 1].tolist()
            b += rows[2, near].tolist()
            for i in np.flatnonzero((sizes > 2) | known).tolist():
                fps = rows[2, begins[i] : ends[i]]
                if known[i] or len(fps) > crowd:
                    a += fps.tolist()
                    b += [None] * len(fps)
                    crowded = (rows[0, begins[i]], rows[1, begins[i]])
                elif links := cluster(fps, distance):
                    x, y = zip(*links, strict=True)
                    a += x
                    b += y
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        rows = np.concatenate([rest, np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], np.int64)], axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        at = int(last[-1]) + 1 if len(last) else 0
        if rows.shape[1] - at > crowd:  # the last key is a crowd already; what comes of it later is, too
            yield flush(rows)
            rest = rows[:, :0]
        else:
            yield flush(rows[:, :at])
            rest = rows[:, at:]
    yield flush(rest)


def exact_star(crowd: DataFrame) -> DataFrame:
    """Links (a, b) among all fingerprints (a) within four bits, by the words within two bits of each."""
    bits = [1 << i for i in range(64)]
    words = [0, *bits, *(x | y for x, y in combinations(bits, 2))]
    near = F.explode(F.transform(F.array(*(F.lit(w - 2**64 if w >= 2**63 else w) for w in words)), lambda m: m.bitwiseXOR(F.col("a"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = first = None
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.concatenate([[word is None or keys[0] != word], keys[1:] != keys[:-1]])
            heads = np.where(new, np.arange(len(keys)), -1)
            heads = np.maximum.accumulate(heads)
            firsts = np.where(heads >= 0, fps[np.maximum(heads, 0)], first if first is not None else 0)
            word, first = keys[-1], firsts[-1]
            links = np.unique(np.array([fps, firsts]).T[fps != firsts], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], ["a", "b"])

    return crowd.select(near.alias("word"), "a").repartition("word").sortWithinPartitions("word", "a").mapInArrow(run, "a long, b long").distinct()


def fingerprint_links(fps: DataFrame, *, distance: int = DISTANCE, blocks: int | None = None, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect exactly those distinct fingerprints (fp) that a chain of pairs within ``distance`` connects."""
    if distance > 4:
        raise ValueError("crowds are linked exactly for up to four bits")
    blocks = blocks or blocks_for(fps.count(), distance)
    masks = F.array(*(F.lit(m) for m in block_masks(blocks, blocks - distance)))
    keyed = fps.select("fp", F.posexplode(masks).alias("combo", "mask")).select(F.col("combo").cast("long").alias("combo"), F.col("mask").bitwiseAND(F.col("fp")).alias("masked"), "fp")
    found = cut(keyed.repartition("combo", "masked").sortWithinPartitions("combo", "masked").mapInArrow(lambda x: link_sorted(x, distance, crowd), "a long, b long").distinct())
    links = found.filter("b is not null")
    if distance == 4 and not (crowded := found.filter("b is null")).isEmpty():
        links = links.unionByName(exact_star(crowded.select("a")))
    elif distance < 4 and not found.filter("b is null").isEmpty():
        raise ValueError("crowds need a distance of four")
    return links


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of every document."""
    fps = cut(fingerprints(docs))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    known = cut(distinct.join(components(fingerprint_links(distinct)).withColumnRenamed("node", "fp"), "fp", "left"))
    linked = known.filter("root is not null")
    # Stored, so that both sides of the next join are dealt by it alone, and a hot root's part can be split.
    least = cut(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = known.filter("root is null").select("fp", F.col("least").alias("component_id")).unionByName(linked.join(least, "root").select("fp", "component_id"))
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def minhash_bands(hashes: np.ndarray, rows: int = BAND_ROWS, bands: int = BANDS) -> list[int]:
    """One number (signed) for each band of ``rows`` minwise hashes of a set of shingles."""
    if not len(hashes):
        return [0] * bands
    odd = np.random.default_rng(SEED).integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(rows * bands, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), PORTION // 8):
        mixed = hashes[at : at + PORTION // 8, None] * odd[None, :]
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, mixed.min(0), out=least)
    return [xxhash.xxh64_intdigest(x.tobytes(), i) - 2**63 for i, x in enumerate(least.reshape(bands, rows))]


def text_keys(text) -> list:
    """Two hashes that tell texts apart; null is an empty text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def hashed(docs: DataFrame) -> DataFrame:
    """doc_rank, k1, k2 and text of every row: rows of one id and different texts are different documents."""
    k1, k2 = text_keys(F.col("text"))
    return docs.select(doc_rank(F.col("doc_id")).alias("doc_rank"), k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row for each distinct text: node (a number of its own), doc_rank (its smallest), k1 and k2 (hashes), fp, bands (array of long)."""

    def of(texts: list) -> list[pa.Array]:
        fps, bands = [], []
        for text in texts:
            hashes = shingle_hashes(text, size)
            fps.append(fingerprint(hashes))
            bands.append(minhash_bands(np.unique(hashes)))
        return [pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]

    made = map_texts(hashed(docs), of, "fp long, bands array<long>", ids=("doc_rank", "k1", "k2"))
    grouped = made.groupBy("k1", "k2").agg(F.min("doc_rank").alias("doc_rank"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    return grouped.select(F.monotonically_increasing_id().alias("node"), "doc_rank", "k1", "k2", "fp", "bands")


def band_members(signed: DataFrame) -> DataFrame:
    """band, node, first and before: every member of a band but its first, with the first and the one before it."""
    keyed = signed.select("node", "fp", F.posexplode("bands").alias("band", "value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = first = None  # band, value, node of the row before; its band's first node
        for batch in batches:
            rows = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], np.int64)
            if not rows.shape[1]:
                continue
            if last is not None:
                rows = np.concatenate([last[:, None], rows], axis=1)
            new = np.concatenate([[True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])])
            heads = np.maximum.accumulate(np.where(new, np.arange(rows.shape[1]), 0))
            start = rows[2, heads]
            if last is not None:
                start[heads == 0] = first
            held = np.array([rows[0], rows[2], start, np.roll(rows[2], 1)])[:, ~new]
            last, first = rows[:, -1], start[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], ["band", "node", "first", "before"])

    dealt = keyed.select(F.col("band").cast("long").alias("band"), "value", "node", "fp").repartition("band", "value").sortWithinPartitions("band", "value", "fp", "node")
    return dealt.select("band", "value", "node").mapInArrow(run, "band long, node long, first long, before long")


def fingerprint_members(signed: DataFrame, close: DataFrame) -> DataFrame:
    """The same columns (band -1) for texts whose fingerprints are equal or connected by links ``close``: ``close`` need
    not hold every pair within the distance, but each lies in one group."""
    rooted = components(close).select(F.col("node").alias("fp"), F.col("root").alias("group"))
    groups = cut(signed.select("node", "fp").join(rooted, "fp", "left").select("node", F.coalesce("group", "fp").alias("group")))
    first = cut(groups.groupBy("group").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").select("group", "first"))
    return groups.join(first, "group").filter("node <> first").select(F.lit(-1).cast("long").alias("band"), "node", "first", F.col("first").alias("before"))


def shingle_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node and shingles (distinct hashes) of these nodes (with doc_rank, k1, k2). Only their texts are sent."""
    texts = hashed(docs).join(nodes, ["doc_rank", "k1", "k2"]).select("node", "text")
    made = map_texts(texts, lambda x: [pa.array([np.unique(shingle_hashes(t, size)).view(np.int64) for t in x], pa.list_(pa.int64()))], "shingles array<long>", ids=("node",))
    return cut(made.groupBy("node").agg(F.first("shingles").alias("shingles")))


def similar_pairs(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs whose texts' shingle sets have at least this share in common."""
    both = pairs.join(sets.withColumnsRenamed({"node": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"node": "b", "shingles": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - common
                near.append(total == 0 or common >= similarity * total)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def mixed_members(held: DataFrame, rooted: DataFrame) -> DataFrame:
    """node and root of all members of the groups (band, first) whose members aren't all linked to each other yet."""
    of = lambda name, root: rooted.select(F.col("node").alias(name), F.col("root").alias(root))
    known = held.select("band", "node", "first").join(of("node", "node_root"), "node", "left").join(of("first", "first_root"), "first", "left")
    mixed = cut(known.filter(F.coalesce("node_root", "node") != F.coalesce("first_root", "first")).select("band", "first").distinct())
    nodes = held.join(mixed, ["band", "first"], "left_semi").select("node").unionByName(mixed.select(F.col("first").alias("node"))).distinct()
    return nodes.join(rooted, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def pairs_of_groups(rows: np.ndarray, similarity: float) -> Iterator[np.ndarray]:
    """Pairs (2 x n) of different roots among rows (shingle, size, node, root, cap) of whole groups, sorted by the first two."""
    change = np.flatnonzero(rows[0, 1:] != rows[0, :-1]) + 1
    begins, ends = np.concatenate([[0], change]), np.concatenate([change, [rows.shape[1]]])
    mixed = np.minimum.reduceat(rows[3], begins) != np.maximum.reduceat(rows[3], begins)
    begins, ends = begins[mixed], ends[mixed]
    sizes, few = ends - begins, ends - begins <= FEW

    def fine(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        _, size, _, root, cap = rows
        near = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-6
        return near & (root[i] != root[j]) & (size[i] <= cap[j]) & (size[j] <= cap[i])

    def pairs(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = rows[2, i], rows[2, j]
        return np.unique(np.array([np.maximum(a, b), np.minimum(a, b)]), axis=1)

    at = np.concatenate([np.arange(b, e) for b, e in zip(begins[few], ends[few], strict=True)]) if few.any() else np.empty(0, np.int64)
    until = np.repeat(ends[few], sizes[few])
    for step in range(1, FEW):
        at, until = at[at + step < until], until[at + step < until]
        if not len(at):
            break
        keep = fine(at, at + step)
        yield pairs(at[keep], at[keep] + step)
    for begin, end in zip(begins[~few].tolist(), ends[~few].tolist(), strict=True):
        size, root = rows[1, begin:end], rows[3, begin:end]
        values, counts = np.unique(root, return_counts=True)
        main = root == values[counts.argmax()]  # members of one root needn't be compared with each other
        others = np.flatnonzero(~main)
        low = np.searchsorted(size, similarity * size[others] - 1e-6)
        high = np.searchsorted(size, np.minimum(size[others] / similarity + 1e-6, rows[4, begin + others]), "right")
        width = np.maximum(high - low, 0)
        total = np.cumsum(width)
        done = 0
        while done < len(others):
            till = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + CHUNK, "right")))
            w = width[done:till]
            i = np.repeat(others[done:till], w)
            j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(low[done:till], w)
            once = main[j] | (j > i)
            i, j = i[once] + begin, j[once] + begin
            keep = fine(i, j)
            yield pairs(i[keep], j[keep])
            done = till


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots, all similar ones among them, of a table of node, root and shingles.

    Prefix filter: with all shingles in one order, two sets that are similar enough share one among the first
    size - ceil(similarity * size) + 1 of each; and if it is their first common one, enough must follow it in both.
    Any order is right. This one has rare shingles first, by counts in CELLS cells, so that a passage that many texts
    share comes last and makes few pairs.
    """
    spark = sets.sparkSession
    shift = np.uint64(64 - CELLS.bit_length() + 1)
    cell = lambda x: (x.view(np.uint64) >> shift).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int64)
        for batch in batches:
            n += np.bincount(cell(batch.column(0).flatten().to_numpy(zero_copy_only=False)), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["cell", "n"])

    counted = sets.select("shingles").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    often = np.zeros(CELLS, np.int64)
    often[counted["cell"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    shared = spark.sparkContext.broadcast(often)  # CELLS numbers, whatever the input

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.empty((5, 0), np.int64)]
            for node, root, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = shingles.values.to_numpy(zero_copy_only=False)
                n, rare = len(x), shared.value[cell(x)]
                order = np.lexsort((x, rare))[: n - int(np.ceil(similarity * n - 1e-6)) + 1]
                places = np.flatnonzero(rare[order] > 1)
                caps = np.floor((n - places) * (1 + similarity) / similarity - n + 1e-6).astype(np.int64)
                out.append(np.array([x[order[places]], np.full(len(places), n), np.full(len(places), node), np.full(len(places), root), caps], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(out, axis=1)], ["shingle", "size", "node", "root", "cap"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []  # rows since the last flush; the last group of them may go on
        for batch in batches:
            rows = np.array([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)], np.int64)
            if not rows.shape[1]:
                continue
            parts.append(rows)
            if parts[0][0, 0] == rows[0, -1]:
                continue
            rows = np.concatenate(parts, axis=1)
            at = int(np.flatnonzero(rows[0] != rows[0, -1])[-1]) + 1
            yield from map(linked, pairs_of_groups(rows[:, :at], similarity))
            parts = [rows[:, at:]]
        if parts:
            yield from map(linked, pairs_of_groups(np.concatenate(parts, axis=1), similarity))

    def linked(pairs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], ["a", "b"])

    dealt = sets.select("node", "root", "shingles").mapInArrow(prefixes, "shingle long, size long, node long, root long, cap long")
    return dealt.repartition("shingle").sortWithinPartitions("shingle", "size", "node").mapInArrow(meet, "a long, b long").distinct()


def near_duplicate_links(docs: DataFrame, *, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Signatures of the distinct texts, and links (a, b) of similar ones, between their nodes.

    First each member of a band is compared with the band's first and the one before it, and texts whose fingerprints
    a chain of close ones connects with the first of them. Where that leaves the members of such a group in more than
    one component, all pairs of different components among such members are candidates.
    """
    signed = stored(signatures(docs, size), "simhash")
    fps = signed.groupBy("fp").agg(F.min("node").alias("node"))
    close = cut(fingerprint_links(fps.select("fp")))
    by_fp = fps.withColumnsRenamed({"fp": "key", "node": "at"})
    simhash = close.join(by_fp, close["a"] == by_fp["key"]).select(F.col("at").alias("a"), "b").join(by_fp.withColumnRenamed("at", "to"), F.col("b") == F.col("key")).select("a", F.col("to").alias("b"))
    bands = band_members(signed)
    held = cut(bands.unionByName(fingerprint_members(signed, close)))
    stars = held.select(F.col("node").alias("a"), F.explode(F.array("first", "before")).alias("b"))
    pairs = cut(stars.unionByName(simhash).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(signed.select("node", "doc_rank", "k1", "k2").join(wanted, "node", "left_semi"), docs, size)
    links = cut(similar_pairs(pairs, sets, similarity))
    left = cut(mixed_members(held, components(links)))
    if left.isEmpty():
        return signed, links
    more = cut(prefix_pairs(sets.join(left, "node"), similarity))
    return signed, links.unionByName(similar_pairs(more, sets, similarity))


def drop_near_duplicates(docs: DataFrame, *, size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that have an equal or similar one of smaller rank in their group."""
    signed, links = near_duplicate_links(docs, size=size, similarity=similarity)
    rooted = components(links).select("node", F.col("root").alias("component"))
    known = signed.select("node", "doc_rank", "k1", "k2").join(rooted, "node", "left")
    one = F.struct("doc_rank", "k1", "k2")
    known = cut(known)
    groups = known.filter("component is not null").groupBy("component").agg(F.min(one).alias("one")).select("one.*")
    keep = cut(known.filter("component is null").select("doc_rank", "k1", "k2").unionByName(groups))
    names = {x: free_name(docs, f"near_duplicate_{x}") for x in ("doc_rank", "k1", "k2")}
    values = [doc_rank(column(docs, "doc_id")), *text_keys(column(docs, "text"))]
    kept = docs.withColumns(dict(zip(names.values(), values, strict=True))).join(keep.toDF(*names.values()), list(names.values()), "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(list(names.values()))  # rows of one id and text are one document
    return kept.select(*(column(kept, c) for c in docs.columns))
