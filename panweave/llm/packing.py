"""Packing: documents into sequences of equal capacity by first-fit decreasing.

Documents longer than the capacity are cut into full sequences and a rest. All pieces are stored and dealt at random, by a hash of
their row in that table, to groups of about GROUP pieces, and every group is packed by itself: pieces by
falling length, each into the first sequence that has room, found in a tournament tree of the sequences' free
room in steps of the tree's height. No group grows with the corpus, whatever ids and texts its rows have.

Defined cases: null and empty texts are one token, the end-of-document id. Empty tables give empty results.
Repeated rows are packed one by one, each with pieces of its own. Pieces of equal length go by document and
start. A null doc_id sorts first. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panweave.llm.common import cut, sliced
from panweave.llm.word_tokens import word_tokens

#: Texts encoded together: the more, the more runs they share; the fewer, the less memory.
TEXTS = 5000
CAPACITY, END_OF_DOCUMENT, GROUP = 4096, 2, 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """The leftmost of n places whose value is at least as large as asked, in log n steps."""

    def __init__(self, n: int, value: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.tree = [value] * (2 * self.size)

    def first(self, least: int) -> int:
        at, tree = 1, self.tree
        while at < self.size:
            at *= 2
            if tree[at] < least:
                at += 1
        return at - self.size

    def take(self, place: int, amount: int) -> int:
        """Lowers a value and plays its matches again; the value before."""
        at, tree = place + self.size, self.tree
        before = tree[at]
        tree[at] = before - amount
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return before


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """For each length, which must fall, its bin and its offset there."""
    rooms, out = Tournament(len(lengths), capacity), []
    for n in lengths:
        place = rooms.first(n)
        out.append((place, capacity - rooms.take(place, n)))
    return out


def cut_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END_OF_DOCUMENT) -> DataFrame:
    """PIECES: the tokens of every document and its end id, cut at each multiple of the capacity."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = end.to_bytes(4, "little")
        for batch in sliced(batches, TEXTS):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), word_tokens(path).ids(batch.column(1)), strict=True):
                data, n = ids + last, len(ids) // 4 + 1
                rows += [(doc, at, min(capacity, n - at), zlib.crc32(data[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end: int = END_OF_DOCUMENT, group: int = GROUP) -> DataFrame:
    """PIECES with sequence_id and offset."""
    pieces = cut(cut_documents(docs, path, capacity=capacity, end=end))
    groups = max(1, -(-pieces.count() // group))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable", na_position="first")
        places = first_fit_decreasing(rows["length"].tolist(), capacity)
        return rows.assign(sequence_id=[(int(g) << 32) + p for g, (p, _) in zip(rows["pack_group"], places, strict=True)], offset=[o for _, o in places]).drop(columns="pack_group")

    # The row's number in the stored table is the same whenever a task runs again.
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(packed, PIECES + ", sequence_id long, offset long")
