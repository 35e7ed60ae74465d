"""Licence scans: an Aho-Corasick automaton finds tags and notice phrases, a shunting-yard parser evaluates
licence expressions.

Words are the runs of digits, lower-cased letters and non-ASCII characters of a whole text. The base phrases
(BASE) and further notices (NOTICES) are found as consecutive words; an identifier tag (TAG) with a colon after it starts
a licence expression with AND, OR, WITH and brackets, which ends where its line does or where an operator is missing.

Defined cases: a null text counts as empty (no words, no labels, score 0). Empty tables give empty results.
Repeated rows are scanned one by one and equally. An expression that can't be parsed adds the label "unparsed"
and no score. Labels are sorted, so ties have no order of their own. Other columns are not looked at.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from panweave.llm.common import map_texts

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notices and their labels.
NOTICES = {
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc0": "cc0", "bsd license": "bsd", "3 clause bsd": "bsd", "2 clause bsd": "bsd",
    "mozilla public license": "mpl", "lesser general public license": "lgpl", "affero general public license": "agpl", "isc license": "isc",
    "public domain": "public-domain", "all rights reserved": "all-rights-reserved", "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAG = "spdx license identifier"
#: How freely a text under this label may be used, 0 to 1.
OPENNESS = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "cc-by": 0.9, "mpl": 0.7, "lgpl": 0.6,
    "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0,
}
EXCEPTION_GAIN = 0.2
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_expressions long"
#: A-Z to a-z; all other ASCII but digits and letters to spaces.
WORDS = bytes(i + 32 if 0x41 <= i <= 0x5A else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20 for i in range(256))


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, kind in [*((p, "base") for p in BASE), *((p, "notice") for p in NOTICES), (TAG, "tag")]:
        found.add_word(f" {phrase} ", (phrase, kind))
    found.make_automaton()
    return found


def label_of(identifier: str) -> str:
    """The label of a licence identifier such as GPL-2.0-only."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    return re.sub(r"-v?\d[\d.]*(-clause)?(?=-|$)", "", name) or name


BINDS = {"OR": 1, "AND": 2, "WITH": 3}
OPERATORS = {*BINDS, *(x.lower() for x in BINDS)}
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:_-]*)")


def tokens(text: str) -> list[str]:
    """The tokens of an expression at the start of a text."""
    out, at = [], 0
    while found := TOKEN.match(text, at):
        out.append(found[1].rstrip(".:") or found[1])
        at = found.end()
    return out


def first_expression(read: list[str]) -> list[str]:
    """As many of the tokens as make one expression: an operand outside brackets without an operator before it ends it."""
    depth, operand = 0, False
    for i, token in enumerate(read):
        if operand and depth == 0 and token not in OPERATORS and token != ")":
            return read[:i]
        depth += (token == "(") - (token == ")")
        operand = token not in OPERATORS and token != "("
    return read


def parse(expression: str) -> list[str]:
    """The expression in postfix order, by the shunting-yard algorithm. WITH binds closest, then AND, then OR."""
    return postfix(tokens(expression))


def postfix(read: list[str]) -> list[str]:
    out, stack, operand = [], [], False
    for token in read:
        if token in OPERATORS:
            if not operand:
                raise ValueError(f"operand missing before {token}")
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token.upper()]:
                out.append(stack.pop())
            stack.append(token.upper())
            operand = False
        elif token == "(":
            if operand:
                raise ValueError("operator missing before (")
            stack.append(token)
        elif token == ")":
            if not operand:
                raise ValueError("operand missing before )")
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ValueError("( missing")
            stack.pop()
        else:
            if operand:
                raise ValueError(f"operator missing before {token}")
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        raise ValueError("expression not ended")
    return out + stack[::-1]


def evaluate(expression: str | list[str]) -> tuple[set[str], float]:
    """The labels of an expression and its openness: OR takes the freest side, AND the strictest, WITH eases a bit."""
    stack: list[tuple[set[str], float, str]] = []
    for token in parse(expression) if isinstance(expression, str) else postfix(expression):
        if token in ("OR", "AND", "WITH"):
            right, left = stack.pop(), stack.pop()
            if token == "WITH":
                stack.append((left[0], min(1.0, left[1] + EXCEPTION_GAIN), ""))
            else:
                stack.append((left[0] | right[0], (max if token == "OR" else min)(left[1], right[1]), ""))
        else:
            stack.append(({label_of(token)}, OPENNESS.get(label_of(token), 0.5), token))
    return stack[0][0], stack[0][1]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def expressions(text: str, tags: list[int]) -> list[list[str]]:
    """The tokens of the expressions after tags, whose last words have these numbers (rising) in the text."""
    out, words, number = [], WORD.finditer(text), -1
    for tag in tags:
        while number < tag:
            found, number = next(words), number + 1
        if colon := re.compile(r"[ \t]*:").match(text, found.end()):
            end = min((x for x in (text.find("\n", colon.end()), text.find("\r", colon.end())) if x >= 0), default=len(text))
            out.append(first_expression(tokens(text[colon.end() : end])))
    return out


def scan(text: str | None) -> tuple:
    """The FIELDS of one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").translate(WORDS).split()
    # A phrase ends and the next may begin at one and the same space, so every word has a space on either side.
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels, levels, tags = [], set(), set(), [], []
    spaces = at = 0  # spaces before this place
    for end, (phrase, kind) in automaton().iter(line):
        if kind != "notice":
            spaces, at = spaces + line.count(" ", at, end), end
        if kind == "tag":
            tags.append(spaces - 1)
            continue
        if kind == "base":
            starts.append(spaces - len(phrase.split()))
            base.add(BASE[phrase])
        label = BASE[phrase] if kind == "base" else NOTICES[phrase]
        labels.add(label)
        levels.append(OPENNESS[label])
    found = expressions(text, tags) if tags else []
    for expression in found:
        try:
            names, level = evaluate(expression)
        except ValueError:
            names, level = {"unparsed"}, None
        labels |= names
        if level is not None:
            levels.append(level)
    joined = lambda x: ",".join(sorted(x))
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), *ends, joined(base), joined(labels), min(levels, default=0.0), len(found)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS of every document. score is the openness of its strictest licence, 0 where there is none."""
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]

    def of(texts: list) -> list[pa.Array]:
        rows = [scan(x) for x in texts]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return map_texts(docs, of, FIELDS)
