"""Token ids of whole texts with a tokenizer file whose pieces never hold white space.

Texts are cut at ASCII white space, which such a tokenizer drops. Of a batch of texts, each distinct run is encoded
once, many runs as one text, and its ids are dealt out to where it stands. All steps but the tokenizer's are
operations on Arrow and NumPy arrays, and nothing is kept from one batch to the next.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs encoded as one text; texts whose ids are dealt out at a time.
TOGETHER, TEXTS = 512, 1000
#: A control character, which such a tokenizer takes as a piece of its own.
MARK = "\x01"
#: Marks that are one piece, if several, at the end of a run after a letter or digit.
TAIL = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
#: Letters that stay one letter when composed and lower-cased; U+0130 doesn't.
LETTER = r"a-zA-Z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}"


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked segments of ``flat``, one after another, and their sizes."""
    n = sizes[picked]
    ends = np.cumsum(n)
    if not len(n) or not ends[-1]:
        return flat[:0], n
    places = np.repeat(starts[picked] - (ends - n), n)
    places += np.arange(ends[-1])
    return flat[places], n


def runs_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs without white space, and where each text's runs begin among them.

    Capitals A-Z go: such a tokenizer lower-cases after composing characters, and without combining marks of the block
    that composes with them the order doesn't matter."""
    # A copy that begins at the buffer's begin: splitting slices of arrays has been seen to return wrong runs.
    texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
    data = texts.cast(pa.large_binary())
    marks = pc.or_(pc.match_substring(data, b"\xcc"), pc.match_substring(data, b"\xcd"))
    lists = pc.ascii_split_whitespace(pc.if_else(marks, texts, pc.ascii_lower(texts)))
    offsets = lists.offsets.to_numpy()
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


class WordTokens:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # For runs of lower-case letters, which composing and the pattern leave as they are.
        self.of_letters = Tokenizer(self.tokenizer.model)
        self.of_letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.marks = np.zeros_like(self.word_ends)
        self.marks[self.tokenizer.encode(MARK, add_special_tokens=False).ids] = True

    def together(self, runs: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs and how many each has. Runs of letters are one piece each, and a piece's last id is the only one
        that ends a word; other runs are set apart by a mark that has an id of its own."""
        tokenizer, mark, at_end = (self.of_letters, " ", self.word_ends) if letters else (self.tokenizer, f" {MARK} ", self.marks)
        ids, sizes = [], []
        for at in range(0, len(runs), TOGETHER):
            part = runs[at : at + TOGETHER]
            text = mark.join(part)
            text = text.lower() if letters else f"{text} {MARK}"
            got = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(at_end[got])
            n = np.diff(ends, prepend=-1)
            if not letters:
                got, n = np.delete(got, ends), n - 1
            if len(n) != len(part):
                raise AssertionError("runs and their ids don't match")
            ids.append(got)
            sizes.append(n)
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate([np.empty(0, np.int64), *sizes])

    def encode(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct runs: all ids, where each run's begin, and how many there are."""
        of_letters = pc.match_substring_regex(runs, f"^[{LETTER}]+$").to_numpy(zero_copy_only=False)
        marked = pc.match_substring(runs, MARK).to_numpy(zero_copy_only=False)
        parts = []
        for chosen, letters in ((of_letters, True), (~of_letters & ~marked, False)):
            places = np.flatnonzero(chosen)
            parts.append((places, *self.together(runs.take(pa.array(places)).to_pylist(), letters)))
        for place in np.flatnonzero(marked):
            ids = np.array(self.tokenizer.encode(runs[int(place)].as_py(), add_special_tokens=False).ids, np.uint32)
            parts.append((np.array([place]), ids, np.array([len(ids)])))
        sizes = np.zeros(len(runs), np.int64)
        starts = np.zeros(len(runs), np.int64)
        before = 0
        for places, ids, n in parts:
            sizes[places] = n
            starts[places] = before + np.cumsum(n) - n
            before += len(ids)
        return np.concatenate([ids for _, ids, _ in parts]), starts, sizes

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for distinct words, by their stems and the marks at their ends, which are pieces of their own."""
        stems = pc.ascii_rtrim(words, TAIL)
        last = pc.utf8_slice_codeunits(stems, -1).dictionary_encode()
        plain = pc.match_substring_regex(last.dictionary, f"^[0-9{LETTER}]$").to_numpy(zero_copy_only=False)
        ended = plain[last.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, bool)
        stems = pc.if_else(pa.array(ended), stems, words)
        sizes = pc.binary_length(stems).to_numpy(zero_copy_only=False)
        tails = [w[n:] for w, n in zip(words.cast(pa.large_binary()).filter(pa.array(ended)).to_pylist(), sizes[ended].tolist(), strict=True)]
        every = pa.concat_arrays([stems, pa.array(np.array([x.decode() for x in tails], object), pa.large_string()) if tails else stems[:0]]).dictionary_encode()
        ids, starts, counts = self.encode(every.dictionary)
        picked = every.indices.to_numpy(zero_copy_only=False)
        tail_of = np.full(len(words), -1)
        tail_of[ended] = picked[len(words) :]
        # Each word is two segments, its stem and its tail, the latter perhaps empty.
        starts, counts = np.append(starts, 0), np.append(counts, 0)
        pairs = np.column_stack([picked[: len(words)], tail_of]).ravel()
        flat, n = gather(ids, starts, counts, pairs)
        n = n.reshape(-1, 2).sum(1)
        return flat, np.cumsum(n) - n, n

    def ids(self, texts: pa.Array | list) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; none of a null or empty one."""
        words, offsets = runs_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        coded = words.dictionary_encode()
        flat, starts, sizes = self.encode_words(coded.dictionary)
        picked = coded.indices.to_numpy(zero_copy_only=False)
        out: list[bytes] = []
        for at in range(0, len(offsets) - 1, TEXTS):
            cut = offsets[at : at + TEXTS + 1]
            ids, n = gather(flat, starts, sizes, picked[cut[0] : cut[-1]])
            data = ids.astype("<u4", copy=False).tobytes()
            ends = np.concatenate([[0], np.cumsum(n)])[cut - cut[0]] * 4
            out += [data[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        return out


@cache
def word_tokens(path: str) -> WordTokens:
    """Kept by each Python worker."""
    return WordTokens(path)
