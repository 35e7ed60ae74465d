"""Byte-level BPE by monoid tree reduction.

A text is cut by the pattern into pieces, which merges never cross. Within a piece the encodings of the two
halves are joined: a window of tokens around the seam is encoded anew and grows until the tokens next to it
are stable. A pair of neighbours is stable if both tokens are the encodings of their own bytes, which is checked for each
token once, and the encoding of the two tokens' bytes is that pair; a sequence is the encoding of its bytes if and only if all
neighbours are stable, so tokens outside a stable window can't change. A window may grow to the whole piece, which
is then merged by itself. Decoding concatenates up the same tree. Encodings of short byte strings and of whole words are kept in
bounded tables.

Defined cases: null and empty texts have no ids (n_tokens 0, digests of nothing). Empty tables give empty results.
Repeated rows are encoded one by one and equally. Texts of any length are encoded whole; long pieces cost
n log n for each level of the tree at most. Special tokens in texts are ordinary text. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from panweave.llm.common import map_texts

FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
NEVER = 1 << 62  # no rank
#: Texts whose units are looked up together.
TEXTS = 4000
#: Bytes of a tree's leaves, which are merged plainly, and of a window that is merged without a heap.
LEAF, SHORT = 4, 48
#: Entries of each generation of a Python worker's tables, bytes of the largest entry.
KEPT_WORDS, KEPT_PARTS, KEPT_BYTES = 250_000, 200_000, 48


class Encoder:
    """Encodes and decodes with one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.parts: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self.words: dict[str, tuple[str, bytes]] = {}
        self.old_words: dict[str, tuple[str, bytes]] = {}

    def leaf(self, data: bytes) -> tuple[int, ...]:
        """Merges of lowest rank first, leftmost first; meant for a few bytes."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        rank = ranks.get
        pairs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]  # of each part and the next one
        while pairs and (best := min(pairs)) < NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
        return tuple(ranks[p] for p in parts)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The same for many bytes, with the pairs in a heap."""
        if len(data) <= SHORT:
            return self.leaf(data)
        rank, n = self.ranks.get, len(data)
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        pairs = [rank(data[i : i + 2], NEVER) for i in range(n - 1)] + [NEVER]
        heap = [(r, i) for i, r in enumerate(pairs) if r < NEVER]
        heapify(heap)
        while heap:
            r, i = heappop(heap)
            if pairs[i] != r:
                continue  # the pair has changed since
            j = after[i]
            ends[i], after[i], pairs[j] = ends[j], after[j], NEVER
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    pairs[k] = rank(data[k : ends[after[k]]], NEVER) if after[k] < n else NEVER
                    if pairs[k] < NEVER:
                        heappush(heap, (pairs[k], k))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : ends[i]]])
            i = after[i]
        return tuple(out)

    def is_sound(self, a: int) -> bool:
        """Whether a token is the encoding of its own bytes."""
        if (known := self.sound.get(a)) is None:
            known = self.sound[a] = self.merge(self.bytes_of[a]) == (a,)
        return known

    def stable(self, a: int, b: int) -> bool:
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= KEPT_PARTS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.is_sound(a) and self.is_sound(b) and self.short(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
        return known

    def short(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a window, by merges and kept: seams need the same ones again and again."""
        if (known := self.parts.get(data)) is None:
            known = self.merge(data)
            if len(data) <= KEPT_BYTES:
                if len(self.parts) >= KEPT_PARTS:
                    self.parts.clear()
                self.parts[data] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two neighbouring encodings' bytes."""
        if not left or not right:
            return left or right
        reach = 1
        if self.stable(left[-1], right[0]):
            return left + right
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            middle = self.short(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            if (i == 0 or self.stable(left[i - 1], middle[0])) and (j == len(right) or self.stable(middle[-1], right[j])):
                return left[:i] + middle + right[j:]
            reach *= 2

    def encode_piece(self, data: bytes) -> tuple[int, ...]:
        """The encoding of one piece: leaves, then seams, up a balanced tree."""
        if (whole := self.ranks.get(data)) is not None:
            return (whole,)
        if len(data) <= LEAF:
            return self.leaf(data)
        level = [self.short(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids) -> bytes:
        """Bytes of the ids, concatenated up a tree."""
        level = [self.bytes_of[i] for i in ids]
        while len(level) > 1:
            level = [b"".join(level[i : i + 16]) for i in range(0, len(level), 16)]
        return level[0] if level else b""

    def pieces(self, unit: str) -> list[str]:
        """The pieces of a unit. For letters alone, or with marks after them, there is no need of the pattern."""
        if unit[1:].isalpha() and (unit[0] == " " or unit[0].isalpha()):
            return [unit]
        stem = unit.rstrip(".,")
        if stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
            return [stem, unit[len(stem) :]]
        return self.pattern.findall(unit)

    def word(self, unit: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the bytes that they decode to, of a run between pattern boundaries."""
        if (made := self.old_words.get(unit)) is None:
            pieces = self.pieces(unit)
            if len(pieces) == 1:
                ids = self.encode_piece(unit.encode("utf-8", "surrogatepass"))
                made = ",".join(map(str, ids)), self.decode(ids)
            else:  # most pieces are known from other units
                found = [self.words.get(p) or self.word(p) for p in pieces]
                made = ",".join([x for x, _ in found]), b"".join([x for _, x in found])
        if len(unit) <= KEPT_BYTES:
            if len(self.words) >= KEPT_WORDS:  # words in use move on, others go with the old generation
                self.old_words, self.words = self.words, {}
            self.words[unit] = made
        return made

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """n_tokens, ids_sha256 and decoded_sha256."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        found = [self.words.get(u) or self.word(u) for u in units(text, self.pattern)]
        ids = ",".join([x for x, _ in found])
        return ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([x for _, x in found])).hexdigest()

    def digests(self, texts: list) -> list[tuple[int, str, str]]:
        """digest() of each text. Each distinct unit of all of them is looked up once."""
        plain = [i for i, x in enumerate(texts) if x and "  " not in x]
        out = [None if x and "  " not in x else self.digest(x) for x in texts]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        coded, ends = lists.values.dictionary_encode(), lists.offsets.to_numpy().tolist()
        names = coded.dictionary.to_pylist()
        found = [self.words.get(u) or self.word(u) for u in [" " + x for x in names]]
        ids_of, bytes_of = [x for x, _ in found], [x for _, x in found]
        picked = coded.indices.to_numpy()
        for i, a, b in zip(plain, ends, ends[1:], strict=False):
            first, *rest = picked[a:b].tolist()
            # A text's first unit has no space before it.
            head = [self.words.get(names[first]) or self.word(names[first])] if names[first] else []
            ids = ",".join([x for x, _ in head] + [ids_of[j] for j in rest])
            data = b"".join([x for _, x in head] + [bytes_of[j] for j in rest])
            out[i] = ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()
        return out


def units(text: str, pattern) -> list[str]:
    """A text cut at places where pieces of the pattern always end.

    The last space of a run of white space goes with the word after it. So a piece ends before a space that
    no other space is next to, whatever else is around; texts with two spaces in a row go through the pattern.
    """
    if "  " in text:
        return pattern.findall(text)
    first, *rest = text.split(" ")
    return [first, *(" " + x for x in rest)] if first else [" " + x for x in rest]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """Kept by each Python worker."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and FIELDS of every document. path: a rank file that every executor has installed."""
    kinds = [pa.int64(), pa.string(), pa.string()]

    def of(texts: list) -> list[pa.Array]:
        rows = encoder(path, pattern).digests(texts)
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return map_texts(docs, of, FIELDS, rows=TEXTS)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    return map_texts(docs, lambda texts: [pa.array([encoder(path, pattern).encode(x or "") for x in texts], pa.list_(pa.int32()))], "ids array<int>")
