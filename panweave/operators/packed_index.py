"""The Burrows-Wheeler transform, its rank table and places of suffixes, by packed arrays instead of one row for each suffix.

The text lies in chunks. From each place, the least hash among the words of a window ahead chooses an anchor: suffixes that share their first
``CONTEXT`` characters are as far from their anchors, so their order is that of the anchors' suffixes. About one place in ten is an
anchor, and the context of an anchor says where the next one is; so anchors are ranked by prefixes four times as long in each step,
and a look ahead is a shift by whole anchors. Then all suffixes are dealt by ranges of contexts, a part of the ranges at a time, and
each range is sorted by context and anchor's rank. What stays is the transform, and the places of sampled suffixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panweave.functions.dna import AS_BASES
from panweave.functions.dna import LETTERS as LETTERS_OF_TEXT
from panweave.operators import text_index
from panweave.operators.junctions import packed, unpacked
from panweave.operators.ranking import drop, release, stored

#: Blocks of a chunk, suffixes that a range should have, contexts of a chunk that are looked at to choose ranges, and parts of the ranges.
SPAN, BUCKET, LOOKED_AT, ROUNDS = 128, 1 << 21, 64, 4
#: Characters of a context (a number below 6^24 fits 64 bits), of a word, and words of a window, all within a context but its first character.
CONTEXT, WORD = 24, 6
WINDOW = CONTEXT - WORD
#: By how much a step lengthens what ranks of anchors compare.
GROWTH = 4
TEXT, RANKS, HEAD = range(3)
LETTERS = np.frombuffer(text_index.LETTERS.encode(), np.uint8)
_RANK = np.int64((1 << 32) - 1)
_PIECE = "key long, what int, data binary"


def _rows(rows: list[tuple], names: str = _PIECE) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [(name, kinds[kind]) for name, kind in (x.split() for x in names.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def _each(make, names: str = _PIECE):
    """A function for mapInArrow: ``make`` gives rows from each row, given as a dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = make({name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)})
                for a in range(0, len(found), 64):
                    yield from _rows(found[a : a + 64], names).to_batches()

    return run


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    new = np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)]
    return np.append(np.nonzero(new)[0], len(sorted_values))


def halves(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    padded = np.append(codes, np.zeros(len(codes) % 2, np.uint8))
    return padded[0::2] << 4 | padded[1::2]


def unhalved(data: np.ndarray, n: int) -> np.ndarray:
    return np.stack([data >> 4, data & 15], axis=1).reshape(-1)[:n]


def looked(codes: np.ndarray, lead: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n places after ``lead``: contexts as numbers, which anchor each has, and the anchors' places (some after the n)."""
    a = np.concatenate([codes, np.zeros(2 * CONTEXT, np.uint8)]).astype(np.int64)
    later = lambda x, k: np.concatenate([x[k:], np.zeros(k, x.dtype)])
    three = (a * 6 + later(a, 1)) * 6 + later(a, 2)
    word = three * 6**3 + later(three, 3)
    twelve = word * 6**6 + later(word, 6)
    context = twelve * 6**12 + later(twelve, 12)
    h = word.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    # The first of the least ones.
    best, have = h.astype(np.uint64) << np.uint64(32) | np.arange(len(h), dtype=np.uint64), 1
    while have < WINDOW:
        step = min(have, WINDOW - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    at = (best[: lead + n] & np.uint64(_RANK)).astype(np.int64)
    new = np.append(True, at[1:] != at[:-1])
    of, places = np.cumsum(new) - 1, at[new]
    skipped = int(np.searchsorted(places, lead))
    return context[lead : lead + n], of[lead:] - skipped, places[skipped:] - lead


def bases(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """strain, seq and len of every row with a base, as of ``sequences.strains_of``: texts are translated as bytes, all letters at once."""
    table = bytes.maketrans((LETTERS_OF_TEXT + LETTERS_OF_TEXT.lower()).encode(), (AS_BASES * 2).encode())
    other = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, t.encode().translate(table, other)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t]
            found = [(i, t.decode(), len(t)) for i, t in found if t]
            kinds = (pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], kind) for j, kind in enumerate(kinds)], ["strain", "seq", "len"])

    return docs.select(F.col(id_column).cast("long"), text_column).mapInArrow(run, "strain long, seq string, len long")


def text_chunks(blocks: DataFrame) -> DataFrame:
    """key (chunk), n, anchors, some and some_anchors (contexts of a few suffixes and anchors) and data, of ``text_index.text_blocks``."""
    span, looked_at = SPAN, LOOKED_AT
    chunk = F.floor(F.col("block") / span).cast("long")
    inside = F.pmod("block", F.lit(span))
    part = lambda to, side, text, asked: F.when(asked, F.struct((chunk + to).alias("key"), F.lit(side).alias("side"), text.alias("chunk")))
    parts = F.array(
        part(0, 0, F.col("chunk"), F.lit(True)),
        part(-1, 1, F.substring("chunk", 1, CONTEXT), (inside == 0) & (F.col("block") > 0)),
        part(1, -1, F.substring("chunk", -WINDOW, WINDOW), inside == span - 1),
    )
    dealt = blocks.select("block", F.explode(F.array_compact(parts)).alias("part")).select("part.key", "block", "part.side", "part.chunk")
    table = np.zeros(256, np.uint8)
    table[LETTERS] = np.arange(len(LETTERS))
    names = "key long, n long, anchors long, some array<long>, some_anchors array<long>, data binary"

    def pack(rows: pa.Table) -> pa.Table:
        parts = sorted(zip(rows.column("side").to_pylist(), rows.column("block").to_pylist(), rows.column("chunk").to_pylist(), strict=True))
        n = sum(len(p[2]) for p in parts if p[0] == 0)
        if not n:
            return _rows([], names)
        lead = sum(len(p[2]) for p in parts if p[0] < 0)
        codes = table[np.frombuffer("".join(p[2] for p in parts).encode(), np.uint8)]
        context, _, places = looked(codes, lead, n)
        places = places[places < n]
        few = lambda x: x[np.unique(np.linspace(0, len(x) - 1, looked_at).astype(np.int64))].tolist() if len(x) else []
        data = packed(codes=codes, size=np.array([lead, n], np.int64))
        return _rows([(rows.column("key")[0].as_py(), n, len(places), few(context), few(context[places]), data)], names)

    return dealt.groupBy("key").applyInArrow(pack, names)


def borders(some: list[int], total: int) -> np.ndarray:
    """Contexts that part all into ranges of about ``BUCKET``."""
    some = np.sort(np.array(some, np.int64))
    return np.unique(some[np.linspace(0, len(some) - 1, total // BUCKET + 2).astype(np.int64)[1:-1]]) if len(some) else some


def anchor_ranks(chunks: DataFrame, edges: np.ndarray) -> DataFrame:
    """key (chunk), tied and data: the ranks of the chunk's anchors by context, and which ones others have, too. A rank is a
    range's number and, below it, how many anchors of the range are smaller."""

    def deal(row: dict) -> list:
        x = unpacked(row["data"])
        context, _, places = looked(x["codes"], *x["size"].tolist())
        context = context[places[places < len(context)]]
        o = np.argsort(context, kind="stable")
        ends = np.concatenate([[0], np.searchsorted(context[o], edges), [len(o)]])
        return [(b, row["key"], packed(rising=context[o[i:j]], index=o[i:j].astype(np.int32))) for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if j > i]

    def rank(rows: pa.Table) -> pa.Table:
        return _reranked(rows, ("rising",), None)

    dealt = chunks.select("key", "data").mapInArrow(_each(deal, "key long, chunk long, data binary"), "key long, chunk long, data binary")
    ranked = dealt.groupBy("key").applyInArrow(rank, "key long, data binary")

    def gather(rows: pa.Table) -> pa.Table:
        return _state(rows.column("key")[0].as_py(), rows.column("data").to_pylist(), None)

    return ranked.groupBy("key").applyInArrow(gather, "key long, tied long, data binary")


def _reranked(rows: pa.Table, columns: tuple[str, ...], old: str | None) -> pa.Table:
    """For the pieces (key, chunk, data) of a range, ranks by ``columns``; with ``old``, within the ranks of that name."""
    bucket = rows.column("key")[0].as_py()
    pieces = [unpacked(d) for d in rows.column("data").to_pylist()]
    join = lambda c: np.concatenate([x[c] for x in pieces])
    keys = [join(c) for c in ((old,) if old else ()) + columns]
    o = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    n = len(o)
    starts = lambda ks: np.append(np.nonzero(np.append(True, np.logical_or.reduce([k[o][1:] != k[o][:-1] for k in ks])))[0], n)
    group = starts(keys)
    size = np.diff(group)
    fresh = np.repeat(group[:-1], size)
    if old:
        before = starts(keys[:1])
        fresh = fresh - np.repeat(before[:-1], np.diff(before)) + keys[0][o]
    rank, tied = np.empty(n, np.int64), np.empty(n, np.uint8)
    rank[o], tied[o] = fresh + (bucket << 32), np.repeat(size > 1, size)
    ends = np.cumsum([len(x["index"]) for x in pieces])
    out = [(c, packed(index=x["index"], rank=rank[e - len(x["index"]) : e], tied=tied[e - len(x["index"]) : e])) for c, x, e in zip(rows.column("chunk").to_pylist(), pieces, ends.tolist(), strict=True)]
    return _rows(out, "key long, data binary")


def _state(key: int, pieces: list[bytes], before: bytes | None) -> pa.Table:
    found = [unpacked(d) for d in pieces]
    if before is None:
        n = sum(len(x["index"]) for x in found)
        rank, tied = np.zeros(n, np.int64), np.zeros(n, np.uint8)
    else:
        x = unpacked(before)
        rank, tied = x["rank"].copy(), x["tied"].copy()
    for x in found:
        rank[x["index"]], tied[x["index"]] = x["rank"], x["tied"]
    return _rows([(key, int(tied.sum(dtype=np.int64)), packed(rank=rank, tied=tied))], "key long, tied long, data binary")


def refined(state: DataFrame, begin: np.ndarray, open_: np.ndarray, shift: int) -> DataFrame:
    """``state`` after ranks by the ranks of anchors 0, 1, 2, ... times ``shift`` further on. begin: the number of each chunk's first anchor,
    and of all; open_: whether a chunk has tied ranks."""
    growth = GROWTH

    def send(row: dict) -> list:
        c = row["key"]
        out = [(c, 0, 0, row["data"])] if open_[c] else []
        rank = unpacked(row["data"])["rank"]
        for j in range(1, growth):
            low, high = max(0, begin[c] - j * shift), begin[c + 1] - j * shift
            d = max(0, int(np.searchsorted(begin, low, "right")) - 1)
            while low < high and d < len(open_) and begin[d] < high:
                a, b = max(low, begin[d]), min(high, begin[d + 1])
                if a < b and open_[d]:
                    own = rank[a + j * shift - begin[c] : b + j * shift - begin[c]]
                    out.append((d, j, int(a - begin[d]), packed(rank=own)))
                d += 1
        return out

    def form(rows: pa.Table) -> pa.Table:
        found = list(zip(rows.column("j").to_pylist(), rows.column("at").to_pylist(), rows.column("data").to_pylist(), strict=True))
        own = unpacked(next(d for j, _, d in found if j == 0))
        ask = np.nonzero(own["tied"])[0]
        following = np.full((growth, len(own["rank"])), -1, np.int64)  # what lies past the end is smaller than all others
        for j, at, data in found:
            if j:
                rank = unpacked(data)["rank"]
                following[j, at : at + len(rank)] = rank
        rank = own["rank"][ask]
        o = np.argsort(rank >> 32, kind="stable")
        ask, rank = ask[o], rank[o]
        edges = _edges(rank >> 32)
        key = rows.column("key")[0].as_py()
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            more = {f"next{j}": following[j, ask[a:b]] for j in range(1, growth)}
            out.append((int(rank[a] >> 32), key, packed(index=ask[a:b].astype(np.int32), rank=(rank[a:b] & _RANK), **more)))
        return _rows(out, "key long, chunk long, data binary")

    def rerank(rows: pa.Table) -> pa.Table:
        return _reranked(rows, tuple(f"next{j}" for j in range(1, growth)), "rank")

    def update(left: pa.Table, right: pa.Table) -> pa.Table:
        return _state(left.column("key")[0].as_py(), right.column("data").to_pylist(), left.column("data")[0].as_py())

    sent = state.select("key", "data").mapInArrow(_each(send, "key long, j int, at long, data binary"), "key long, j int, at long, data binary")
    formed = sent.groupBy("key").applyInArrow(form, "key long, chunk long, data binary")
    fresh = formed.groupBy("key").applyInArrow(rerank, "key long, data binary")
    return state.groupBy("key").cogroup(fresh.groupBy("key")).applyInArrow(update, "key long, tied long, data binary")


def with_ranks(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """key and data of each chunk: its text, the ranks of its anchors, and of the next chunk's first ones."""

    def heads(row: dict) -> list:
        return [(row["key"] - 1, HEAD, packed(rank=unpacked(row["data"])["rank"][:WINDOW]))]

    def join(rows: pa.Table) -> pa.Table:
        found = dict(zip(rows.column("what").to_pylist(), map(unpacked, rows.column("data").to_pylist()), strict=True))
        if TEXT not in found:
            return _rows([], "key long, data binary")
        # Past the end of the text contexts are unique.
        ranks = [found[w]["rank"] for w in (RANKS, HEAD) if w in found]
        return _rows([(rows.column("key")[0].as_py(), packed(**found[TEXT], rank=np.concatenate([*ranks, np.zeros(WINDOW, np.int64)])))], "key long, data binary")

    parts = chunks.select("key", F.lit(TEXT).alias("what"), "data").unionByName(state.select("key", F.lit(RANKS).alias("what"), "data"))
    return parts.unionByName(state.select("key", "data").mapInArrow(_each(heads), _PIECE)).groupBy("key").applyInArrow(join, "key long, data binary")


def sorted_ranges(full: DataFrame, edges: np.ndarray, ranges: range, width: int, factor: int) -> DataFrame:
    """key (range), n (of each character) and data of the ranges asked for: the transform, and rows (within the range) and places of
    suffixes whose place is a multiple of ``factor``. width: places of a chunk."""

    def deal(row: dict) -> list:
        x = unpacked(row["data"])
        lead, n = x["size"].tolist()
        context, anchor, _ = looked(x["codes"], lead, n)
        low = edges[ranges.start - 1] if ranges.start else 0
        asked = context >= low
        if ranges.stop <= len(edges):
            asked &= context < edges[ranges.stop - 1]
        at = np.nonzero(asked)[0]
        at = at[np.argsort(context[at])]
        context, rank = context[at], x["rank"][anchor[at]]
        # The last character stands before the first one.
        before = np.where(lead + at > 0, x["codes"][lead + at - 1], 0)
        ends = np.concatenate([[0], np.searchsorted(context, edges[ranges.start : ranges.stop - 1]), [len(at)]])
        out = []
        for b, i, j in zip(ranges, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            place = at[i:j] + row["key"] * width
            known = np.nonzero(place % factor == 0)[0]
            if j > i:
                out.append((b, 0, packed(rising=context[i:j], rank=rank[i:j], before=halves(before[i:j]), rising_known=known, place=place[known] // factor)))
        return out

    def order(rows: pa.Table) -> pa.Table:
        pieces = [unpacked(d) for d in rows.column("data").to_pylist()]
        size = [len(x["rising"]) for x in pieces]
        o = np.lexsort((np.concatenate([x["rank"] for x in pieces]), np.concatenate([x["rising"] for x in pieces])))
        codes = np.concatenate([unhalved(x["before"], n) for x, n in zip(pieces, size, strict=True)])[o]
        place = np.full(len(o), -1, np.int64)
        for x, begin in zip(pieces, (np.cumsum(size) - size).tolist(), strict=True):
            place[begin + x["rising_known"]] = x["place"]
        place = place[o]
        known = np.nonzero(place >= 0)[0]
        counts = np.bincount(codes, minlength=len(LETTERS)).tolist()
        return _rows([(rows.column("key")[0].as_py(), counts, packed(before=halves(codes)), packed(rising=known, place=place[known]))], names)

    names = "key long, n array<long>, data binary, known binary"
    return full.mapInArrow(_each(deal), _PIECE).groupBy("key").applyInArrow(order, names)


class Transform:
    """The transform of a text: of each range of sorted suffixes (a row of ``parts``) its characters and the places of sampled suffixes."""

    def __init__(self, blocks: DataFrame, factor: int):
        self.factor, spark = factor, blocks.sparkSession
        chunks = stored(text_chunks(blocks))
        release(spark)
        # A row for each chunk.
        info = chunks.select("key", "n", "anchors", "some", "some_anchors").orderBy("key").collect()
        self.size = sum(r["n"] for r in info)
        begin = np.cumsum([0, *(r["anchors"] for r in info)])
        anchor_edges = borders([c for r in info for c in r["some_anchors"]], int(begin[-1]))
        state, shift = stored(anchor_ranks(chunks, anchor_edges)), 1
        release(spark)
        while tied := {r["key"]: r["tied"] for r in state.select("key", "tied").filter("tied > 0").collect()}:
            fresh = stored(refined(state, begin, np.array([c in tied for c in range(len(info))]), shift))
            drop(state)
            state, shift = fresh, shift * GROWTH
            release(spark)
        full = stored(with_ranks(chunks, state))
        drop(chunks)
        drop(state)
        release(spark)
        edges = borders([c for r in info for c in r["some"]], self.size)
        step, self.parts, width = -(-(len(edges) + 1) // ROUNDS), None, SPAN * text_index.BLOCK
        for a in range(0, len(edges) + 1, step):
            made = stored(sorted_ranges(full, edges, range(a, min(a + step, len(edges) + 1)), width, factor))
            self.parts = made if self.parts is None else self.parts.unionByName(made)
            release(spark)
        drop(full)
        # A row for each range: characters before it, and rows.
        counts = self.parts.select("key", "n").orderBy("key").collect()
        n = np.array([r["n"] for r in counts], np.int64).reshape(-1, len(LETTERS))
        self._keys = np.array([r["key"] for r in counts], np.int64)
        self._before = np.cumsum(n, axis=0) - n
        self._row = self._before.sum(axis=1)
        self._smaller = np.cumsum(n.sum(axis=0)) - n.sum(axis=0)

    def _rows_of(self, make, columns: dict[str, pa.DataType], fields: str) -> DataFrame:
        """Rows from arrays that ``make`` gives for each slice of a range: of its number, its first row, its characters, and counts before it."""
        keys, first, before, letters = self._keys, self._row, self._before, len(LETTERS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, counts, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    i, n = int(np.searchsorted(keys, key)), sum(counts)
                    codes, above = unhalved(unpacked(data.as_py())["before"], n), before[i].copy()
                    for a in range(0, n, 1 << 14):
                        own = codes[a : a + (1 << 14)]
                        found = make(int(first[i]) + a, own, above)
                        yield pa.RecordBatch.from_arrays([pa.array(found[c], t) if not isinstance(found[c], pa.Array) else found[c] for c, t in columns.items()], list(columns))
                        above += np.bincount(own, minlength=letters)

        return self.parts.select("key", "n", "data").mapInArrow(run, fields)

    def rows(self) -> DataFrame:
        """row and ch: the character before each suffix; before the first one, the last of the text."""

        def make(row: int, codes: np.ndarray, above: np.ndarray) -> dict:
            return {"row": np.arange(row, row + len(codes)), "ch": _characters(codes)}

        return self._rows_of(make, {"row": pa.int64(), "ch": pa.string()}, "row long, ch string")

    def rank_table(self) -> DataFrame:
        """row, ch, occ and cum_occ of every row and each of the six characters, as of ``text_index.rank_table``."""
        letters = len(LETTERS)

        def make(row: int, codes: np.ndarray, above: np.ndarray) -> dict:
            own = codes[:, None] == np.arange(letters)
            occ = np.cumsum(own, axis=0) - own + above
            n, smaller = len(codes), np.cumsum(occ, axis=1) - occ
            return {"row": np.repeat(np.arange(row, row + n), letters), "ch": _characters(np.tile(np.arange(letters), n)), "occ": occ.reshape(-1), "cum_occ": smaller.reshape(-1)}

        return self._rows_of(make, {"row": pa.int64(), "ch": pa.string(), "occ": pa.int64(), "cum_occ": pa.int64()}, "row long, ch string, occ long, cum_occ long")

    def positions(self) -> DataFrame:
        """row and pos of every row, by walks through the transform from the sampled ones: a walker's next row is that of the suffix that
        is one character longer. The one at the start goes on at the end, so the last places are met, too."""
        keys, first, before, smaller, size, factor, letters = self._keys, self._row, self._before, self._smaller, self.size, self.factor, len(LETTERS)

        def step(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return _rows([])
            i = int(np.searchsorted(keys, right.column("key")[0].as_py()))
            codes = unhalved(unpacked(right.column("data")[0].as_py())["before"], sum(right.column("n")[0].as_py()))
            moved = np.empty(len(codes), np.int64)
            for c in range(letters):
                own = np.nonzero(codes == c)[0]
                moved[own] = np.arange(len(own)) + (smaller[c] + before[i, c])
            at, walker, out = [], [], []
            for data in left.column("data").to_pylist():
                x = unpacked(data)
                at.append(x["rising"])
                walker.append(x["place"])
            if not at:
                return _rows([])
            at, walker = moved[np.concatenate(at)], np.concatenate(walker)
            o = np.argsort(at)
            at, walker = at[o], walker[o]
            ends = np.append(np.searchsorted(at, first), len(at))
            for b, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                if y > x:
                    out.append((int(keys[b]), 0, packed(rising=at[x:y] - first[b], place=walker[x:y])))
            return _rows(out)

        def met(walked: int):
            """The places of walkers after so many steps: walker w began at w * factor."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                        x = unpacked(data.as_py())
                        pos = x["place"].astype(np.int64) * factor - walked
                        row = x["rising"] + first[np.searchsorted(keys, key)]
                        # The walker from the start meets what the one from the last sample has.
                        own = (pos >= 0) | (size + pos > (size - 1) // factor * factor)
                        row, pos = row[own], np.where(pos < 0, pos + size, pos)[own]
                        for a in range(0, len(row), 1 << 16):
                            yield pa.RecordBatch.from_arrays([pa.array(row[a : a + (1 << 16)]), pa.array(pos[a : a + (1 << 16)])], ["row", "pos"])

            return run

        known = self.parts.select("key", F.col("known").alias("data"))
        out = known.mapInArrow(met(0), "row long, pos long")
        cells = self.parts.select("key", "n", "data")
        for walked in range(1, min(factor, size)):
            known = stored(known.groupBy("key").cogroup(cells.groupBy("key")).applyInArrow(step, _PIECE)).select("key", "data")
            release(known.sparkSession)
            out = out.unionByName(known.mapInArrow(met(walked), "row long, pos long"))
        return out


def _characters(codes: np.ndarray) -> pa.Array:
    text = LETTERS[codes]
    return pa.Array.from_buffers(pa.string(), len(text), [None, pa.py_buffer(np.arange(len(text) + 1, dtype=np.int32).tobytes()), pa.py_buffer(text.tobytes())])
