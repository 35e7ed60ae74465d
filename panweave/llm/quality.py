"""Quality rules as weak supervision.

Each rule looks at one feature of a whole text and votes "good" (2), "bad" (0) or abstains (1). Which documents
are good is a hidden variable; expectation-maximisation over the counts of vote patterns estimates how often
every rule is right for good and for bad documents, and the posterior probability of "good" decides.

One pass over the texts writes the features; patterns are then counted: at most 3 ** RULES rows, whatever the corpus, so they go
to the driver and the posteriors go back as a table of that size. Nothing else is gathered.

Defined cases: a null text counts as empty (no words, base rule failed, not kept). Empty tables give empty
results. Repeated rows are judged one by one and equally. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panweave.llm.common import cut, map_texts, sliced, stored

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(0x41, 0x5B))
LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
ALNUM = LETTERS + b"0123456789"
SPACE = b" \t\n\v\f\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes int"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three consecutive words found at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(distinct := Counter(windows)) == n:
        return 0
    inside = np.zeros(n + 2, bool)
    again = np.fromiter((distinct[w] > 1 for w in windows), bool, n)
    for shift in range(3):
        inside[shift : shift + n] |= again
    return int(inside.sum())


def features(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, votes of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # exactly the ASCII white space
    n = len(words)
    chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    doubled = len(lines) - len(set(lines))
    again = repeated_words(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    return n, chars, symbols, doubled, again, failed, vote_code(raw, words, lines, chars, symbols, doubled, again)


def vote(bad: bool, good: bool) -> int:
    return 0 if bad else 2 if good else 1


def vote_code(raw: bytes, words: list, lines: list, chars: int, symbols: int, doubled: int, again: int) -> int:
    """The rules' votes as digits to the base three."""
    n = max(len(words), 1)
    upper = len(raw) - len(raw.translate(None, UPPER))
    letters = max(len(raw) - len(raw.translate(None, LETTERS)), 1)
    plain = len(raw) - len(raw.translate(None, ALNUM))
    solid = max(len(raw) - sum(map(raw.count, (b" ", b"\n", b"\t", b"\r"))), 1)
    ended = sum(x.rstrip()[-1:] in b".!?:;\"')" for x in lines)
    marked = raw.count(b"!") + raw.count(b"?")
    distinct = len(set(words))
    votes = (
        vote(symbols * 10 > n, symbols * 50 <= n),  # marks of tables, markup and junk
        vote(doubled * 10 > 3 * max(len(lines), 1), doubled * 20 <= len(lines)),  # repeated lines
        vote(again * 10 > 3 * n, again * 20 <= n),  # repeated phrases
        vote(upper * 2 > letters, upper * 5 < letters),  # shouting
        vote(chars < 2 * n or chars > 14 * n, 3 * n <= chars <= 10 * n),  # length of words
        vote(plain * 100 < 89 * solid, plain * 20 > 19 * solid),  # neither letters nor digits
        vote(marked * 4 > n, marked * 20 <= n),  # exclamation
        vote(distinct * 20 < n, distinct * 5 >= n or n > 2000),  # vocabulary
        vote(2 * ended < len(lines), 5 * ended >= 4 * len(lines)) if lines else 1,  # lines that end as sentences do
    )
    code = 0
    for v in votes:
        code = 3 * code + v
    return code


RULES = 9


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every document."""
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int32()]

    def of(texts: list) -> list[pa.Array]:
        rows = [features(x) for x in texts]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return map_texts(docs, of, FEATURES)


def fit(counts: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Posterior probability of "good" for every vote pattern, by expectation-maximisation.

    counts: documents by pattern. A rule speaks of one kind of fault, so it may well call most bad documents
    good; it is only taken to be better than chance (right_good + right_bad >= 1), so the classes can't swap. How many documents are
    good is left open. A pattern without any bad vote says nothing against a document and isn't rejected.
    """
    if not counts:
        return {}
    codes = sorted(counts)
    weight = np.array([counts[c] for c in codes], float)
    digits = np.array([[c // 3**i % 3 for i in range(RULES - 1, -1, -1)] for c in codes])
    says_good, says_bad = (digits == 2).astype(float), (digits == 0).astype(float)
    a, z, pseudo = 0.98, 0.3, 0.001 * weight.sum() + 10
    prior, right_good, right_bad = 0.85, np.full(RULES, a), np.full(RULES, z)
    for _ in range(rounds):
        good = np.log(prior) + says_good @ np.log(right_good) + says_bad @ np.log1p(-right_good)
        bad = np.log1p(-prior) + says_good @ np.log1p(-right_bad) + says_bad @ np.log(right_bad)
        post = 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))
        g, b = weight * post, weight * (1 - post)
        right_bad = np.clip((b @ says_bad + z * pseudo) / (b @ (says_good + says_bad) + pseudo), 0.001, 0.999)
        right_good = np.clip((g @ says_good + a * pseudo) / (g @ (says_good + says_bad) + pseudo), 1 - right_bad, 0.9999)
        prior = float(np.clip((g.sum() + 0.85 * pseudo) / (weight.sum() + pseudo), 0.001, 0.999))
    post = np.where(says_bad.any(1), post, np.maximum(post, 0.5))
    return dict(zip(codes, post.tolist(), strict=True))


def posteriors(feats: DataFrame) -> dict[int, float]:
    """Counts of vote patterns over all documents that pass the base rule (at most 3 ** RULES rows), then fit()."""
    rows = feats.filter(~F.col("base_failed")).groupBy("votes").count().collect()
    return fit({r["votes"]: r["count"] for r in rows})


def judged(feats: DataFrame) -> DataFrame:
    """``feats`` with quality and kept."""
    spark = feats.sparkSession
    # At most 3 ** RULES rows.
    known = spark.createDataFrame(list(posteriors(feats).items()), "votes int, quality double")
    each = feats.join(F.broadcast(known), "votes", "left").select(*feats.columns, F.when(F.col("base_failed"), F.lit(0.0)).otherwise(F.coalesce("quality", F.lit(0.0))).alias("quality"))
    return each.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the features, quality (posterior, 0 to 1) and kept of every document."""
    return judged(cut(quality_features(docs)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that score_quality() keeps, with all their columns. They are stored beside their votes, so that each is
    looked at once."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    fields = [T.StructField(n, f.dataType, True) for n, f in zip(names, docs.schema, strict=True)]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [features(None if x is None else str(x)) for x in batch.column(at).to_pylist()]
            made = [pa.array([r[5] for r in rows], pa.bool_()), pa.array([r[6] for r in rows], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "base_failed", "votes"])

    rows = stored(docs.toDF(*names).mapInArrow(run, T.StructType([*fields, *T._parse_datatype_string("base_failed boolean, votes int")])), "quality")
    return judged(rows).filter("kept").select(*names).toDF(*docs.columns)
