"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses and words. A lexical transducer reads each word letter by letter (a trie of whole words and of
stems) and writes a symbol: insult, threat, target, negation, report, intent, other. Four transducers are composed
into one that reads these symbols: a negation marks what follows it closely; reported speech marks what follows it in the
clause; insults weigh more where a target stands near, before or after; a threat is a verb of harm, which weighs
little by itself, more with a target before it, and most when its target follows, above all after an expression of
intent ("will kill you"). A clause's score is what the composed transducer adds up; clauses without insult or threat
score nothing. A logistic model of the clauses' scores gives the text's score.

The closed classes are given here. Further insults are learned from labelled documents: words, and stems of three to
eight letters, that toxic documents hold far more often than chance explains (a likelihood-ratio test), weighted by
their log-odds. A stem is learned only if it holds in clearly more toxic documents than each of its continuations; so
it stands for a family of words, of which each may be rare. Copies and near copies of a document aren't independent, so one
of each group is learned from: else every word of a copied document would seem an insult. No more than SAMPLE labelled
rows are used, those of the smallest hash. Rows that are held out (crc32 of the id mod 5 is 0) are never learned from.

Defined cases: null and empty texts have no clauses and get the score of the intercept, below 0.5. Without any
labelled row of both kinds, the closed classes and PRIOR decide. Empty tables give empty results. Repeated rows are
scored one by one and equally; a repeated label counts once, and the larger one of differing labels holds; of the texts of
a repeated id, the one of the smallest hash is learned from. Rows with a null id are held out of learning and have
held_out = false. Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest as hash_of

from panweave.llm.common import keep_rows, map_texts, sliced, stored

#: Labelled rows that are learned from, and the fewest toxic documents that hold a learned word.
SAMPLE, LEAST = 20_000, 4
#: The test's statistic (chi-square of one degree; 30 is a chance of 4e-8 for each word), the least and the largest log-odds.
SURE, ODDS, MOST_ODDS = 30.0, 1.5, 6.0
#: Letters of stems, and how many times the toxic documents of each continuation a stem's must be.
STEM_FROM, STEM_TO, WIDER = 3, 8, 1.5
#: Minwise hashes by which copies in the sample are found, and the words of a shingle.
KEYS, SHINGLE = 6, 5
#: The model is fitted to each part's features by the words of the other parts.
PARTS_OF_SAMPLE = 3
#: Words whose symbols a Python worker keeps.
KEPT_WORDS = 200_000

# Closed word classes.
THREATS = "kill hurt destroy murder shoot stab beat burn strangle töten umbringen verletzen schlagen erschießen tuer blesser détruire frapper matar golpear destruir herir".split()
TARGETS = "you your yourself he they him her them du dich dir ihr euch sie er tu te toi vous il elle ils tú te usted él ella ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't won't nicht kein keine nie niemals pas jamais ne nunca jamás".split()
REPORTS = "said says say wrote writes claimed quote quoted called according sagte schrieb laut dit écrit selon dijo escribió según".split()
INTENTS = "will gonna going shall must should i'll we'll werde werden will vais allons voy vamos".split()
INSULTS = "idiot moron imbecile fool scum bastard jerk dummkopf blödmann arschloch imbécile crétin abruti connard idiota imbécil estúpido gilipollas".split()
#: Strength of an insult of the closed class, a log-odds as learned ones are.
GIVEN = 2.0

INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, OTHER = "ITYNRWO"
CLASSES = {w: c for c, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (INTENT, INTENTS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}
CLAUSE = re.compile(r"[.!?;:\n]+")
#: Intercept and weights of log(1 + score) of insults, of threats, of clauses that match, of the strongest clause.
PRIOR = np.array([-2.5, 1.0, 2.5, 0.5, 0.5])


class Lexicon:
    """The lexical transducer: a trie over letters. Words end at "", stems may go on."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.root: dict = {}
        self.symbols: dict[str, tuple[str, float]] = {}  # of words met before
        self.hot: set[str] = set()  # those among them that are insults or threats
        for word, strength in words.items():
            self.add(word, INSULT, strength, whole=True)
        for stem, strength in stems.items():
            self.add(stem, INSULT, strength, whole=False)
        for word, kind in CLASSES.items():
            self.add(word, kind, 1.0, whole=True)

    def add(self, word: str, kind: str, strength: float, *, whole: bool) -> None:
        state = self.root
        for letter in word:
            state = state.setdefault(letter, {})
        state["" if whole else "stem"] = (kind, strength)

    def read(self, word: str) -> tuple[str, float]:
        """The symbol of a word and its strength: a whole word's before a stem's, a longer stem's before a shorter one's."""
        state, best = self.root, (OTHER, 0.0)
        for letter in word:
            if (state := state.get(letter)) is None:
                return best
            best = state.get("stem", best)
        return state.get("", best)

    def any_hot(self, words: set[str]) -> bool:
        """Whether an insult or a threat is among these words, whose symbols are known afterwards."""
        if new := words.difference(self.symbols):
            if len(self.symbols) > KEPT_WORDS:
                self.symbols.clear()
                self.hot.clear()
                new = words
            for word in new:
                found = self.symbols[word] = self.read(word)
                if found[0] in (INSULT, THREAT):
                    self.hot.add(word)
        return not self.hot.isdisjoint(words)


@dataclass(frozen=True)
class Transducer:
    """arcs[state][symbol] = (next state, output, weight of insults, weight of threats); weights are added up."""

    arcs: dict

    start: object = 0


def compose(first: Transducer, second: Transducer) -> Transducer:
    """Reads what ``first`` reads and writes what ``second`` makes of what ``first`` writes; weights add up."""
    start = (first.start, second.start)
    arcs, waiting = {}, [start]
    while waiting:
        state = waiting.pop()
        if state in arcs:
            continue
        arcs[state] = {}
        for symbol, (a, written, *w) in first.arcs[state[0]].items():
            b, out, *v = second.arcs[state[1]][written]
            arcs[state][symbol] = ((a, b), out, w[0] + v[0], w[1] + v[1])
            waiting.append((a, b))
    return Transducer(arcs, start)


def run(transducer: Transducer, symbols: list[str]) -> tuple[list[str], list[float], list[float]]:
    """What a transducer writes and the weights of each step."""
    state, out, insults, threats = transducer.start, [], [], []
    for symbol in symbols:
        state, written, i, t = transducer.arcs[state][symbol]
        out.append(written)
        insults.append(i)
        threats.append(t)
    return out, insults, threats


def negation(reach: int = 3) -> Transducer:
    """Insults and threats up to ``reach`` symbols after a negation become lower-case."""
    arcs = {}
    for left in range(reach + 1):
        arcs[left] = {x: (max(left - 1, 0), x.lower() if left and x in (INSULT, THREAT) else x, 0.0, 0.0) for x in (INSULT, THREAT, TARGET, REPORT, INTENT, OTHER)}
        arcs[left][NEGATION] = (reach, OTHER, 0.0, 0.0)
    return Transducer(arcs)


def reported() -> Transducer:
    """Insults and threats after a verb of speech, to the end of the clause, become "p" and "q"."""
    marks = {INSULT: "p", THREAT: "q", "i": "p", "t": "q"}
    read = [INSULT, THREAT, "i", "t", TARGET, INTENT, OTHER]
    plain = {x: (0, x, 0.0, 0.0) for x in read} | {REPORT: (1, OTHER, 0.0, 0.0)}
    quoted = {x: (1, marks.get(x, x), 0.0, 0.0) for x in read} | {REPORT: (1, OTHER, 0.0, 0.0)}
    return Transducer({0: plain, 1: quoted})


def insulting(before: int = 6, after: int = 3) -> Transducer:
    """Insults weigh 1, and 0.3 more near a target: up to ``before`` symbols after it, or ``after`` before it. 0.2 negated,
    0.4 reported. What it reads it writes, insults as other words."""
    arcs = {}
    for left in range(before + 1):
        for waits in range(after + 1):  # an insult without a target yet
            on, less = max(left - 1, 0), max(waits - 1, 0)
            same = {x: ((on, less), x, 0.0, 0.0) for x in (THREAT, "t", "q", INTENT, OTHER)}
            arcs[left, waits] = same | {
                INSULT: ((on, 0 if left else after), OTHER, 1.3 if left else 1.0, 0.0), "i": ((on, less), OTHER, 0.2, 0.0), "p": ((on, less), OTHER, 0.4, 0.0),
                TARGET: ((before, 0), TARGET, 0.3 if waits else 0.0, 0.0),
            }
    return Transducer(arcs, (0, 0))


def threatening(before: int = 4, after: int = 3) -> Transducer:
    """A verb of harm weighs 0.3, 0.3 more up to ``before`` symbols after a target; 1 more when a target follows within
    ``after`` symbols, and 0.5 beyond that if intent was expressed up to ``before`` symbols before the verb. 0.1 negated or reported."""
    arcs = {}
    for left in range(before + 1):
        for will in range(before + 1):
            for waits in range(after + 1):
                for meant in (False, True) if waits else (False,):
                    on, fades, less = max(left - 1, 0), max(will - 1, 0), max(waits - 1, 0)
                    plain = (on, fades, less, meant and less > 0)
                    arcs[left, will, waits, meant] = {
                        THREAT: ((on, fades, after, will > 0), THREAT, 0.0, 0.6 if left else 0.3), "t": (plain, OTHER, 0.0, 0.1), "q": (plain, OTHER, 0.0, 0.1),
                        TARGET: ((before, fades, 0, False), OTHER, 0.0, (1.5 if meant else 1.0) if waits else 0.0), INTENT: ((on, before, less, meant and less > 0), OTHER, 0.0, 0.0), OTHER: (plain, OTHER, 0.0, 0.0),
                    }
    return Transducer(arcs, (0, 0, 0, False))


PARTS = (negation(), reported(), insulting(), threatening())
GRAMMAR = reduce(compose, PARTS)


def clause_score(words: list[str], lexicon: Lexicon) -> tuple[float, float]:
    """What the grammar finds in one clause: insults by their strengths, and threats. A target that follows an insult
    adds to the last insult's strength."""
    state, insult, threat, arcs, last, known = GRAMMAR.start, 0.0, 0.0, GRAMMAR.arcs, 1.0, lexicon.symbols
    for word in words:
        kind, strength = known.get(word) or lexicon.read(word)
        if kind == INSULT:
            last = strength
        state, _, i, t = arcs[state][kind]
        insult += i * last
        threat += t
    return insult, threat


def text_features(text: str | None, lexicon: Lexicon) -> tuple[float, float, float, float]:
    """log(1 + insults), log(1 + threats), log(1 + matched clauses), log(1 + strongest clause)."""
    text = (text or "").lower()
    if not lexicon.any_hot(set(words_of(text))):
        return 0.0, 0.0, 0.0, 0.0
    insult, threat, matched, strongest, hot = 0.0, 0.0, 0, 0.0, lexicon.hot
    for clause in CLAUSE.split(text):
        words = words_of(clause)
        if hot.isdisjoint(words):
            continue
        i, t = clause_score(words, lexicon)
        insult, threat, matched, strongest = insult + i, threat + t, matched + (i + t > 0.5), max(strongest, i + t)
    return tuple(float(np.log1p(x)) for x in (insult, threat, matched, strongest))


MARKS = {i: " " for i in range(0x21, 0x80) if not chr(i).isalnum() and i != 0x27}


def words_of(text: str) -> list[str]:
    """Words of lower-cased text: runs without white space and ASCII marks."""
    return text.translate(MARKS).split()


@dataclass(frozen=True)
class Model:
    insults: dict  # learned words and their strengths
    stems: dict
    weights: np.ndarray

    @cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon({**dict.fromkeys(INSULTS, GIVEN), **self.insults}, self.stems)

    def scores(self, texts: list) -> np.ndarray:
        x = np.array([text_features(t, self.lexicon) for t in texts], float).reshape(len(texts), 4)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -30, 30)))


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> float:
    """Negative log-likelihood, and the distance to PRIOR."""
    z = x @ w
    return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * np.sum((w - PRIOR) ** 2))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 100) -> np.ndarray:
    """Weights by Newton's method, drawn to PRIOR; those of features stay above zero. Steps that don't lower the loss are halved."""
    x, w = np.column_stack([np.ones(len(x)), x]), PRIOR.copy()
    best = loss(x, y, w, ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - PRIOR)
        free = ~((w <= 0) & (gradient > 0))  # weights at zero that would fall stay there
        free[0] = True
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hessian[np.ix_(free, free)], gradient[free])
        size = 1.0
        while size > 1e-6:
            new = w - size * step
            new[1:] = np.maximum(new[1:], 0)
            if (now := loss(x, y, new, ridge)) < best:
                break
            size /= 2
        else:
            break
        done = best - now < 1e-9 * max(1.0, best)
        w, best = new, now
        if done:
            break
    return w


def held_out():
    """Whether a row is only for testing; null ids aren't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def terms_of(text: str | None) -> set[str]:
    """A text's words, each with a space after it, and their proper stems."""
    words = set(words_of((text or "").lower()))
    return {f"{w} " for w in words} | {w[:n] for w in words for n in range(STEM_FROM, min(STEM_TO, len(w) - 1) + 1)}


def part_of(doc_id: int) -> int:
    return hash_of(str(doc_id), 1) % PARTS_OF_SAMPLE


def term_counts(batches: Iterator[pa.RecordBatch], wanted: set[int]) -> Iterator[pa.RecordBatch]:
    """term and a list of counts: of the wanted documents of each part that hold it, the clean and the toxic ones; in one row
    with a null term, the documents themselves."""
    kinds = [pa.string(), pa.list_(pa.int64())]
    for batch in sliced(batches):
        counts, total = [Counter() for _ in range(2 * PARTS_OF_SAMPLE)], [0] * (2 * PARTS_OF_SAMPLE)
        for doc_id, label, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if doc_id in wanted:
                at = 2 * part_of(doc_id) + label
                counts[at].update(terms_of(text))
                total[at] += 1
        terms = set().union(*counts)
        rows = [(None, total), *((w, [c[w] for c in counts]) for w in terms)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["term", "n"])


def copy_keys(texts: list) -> list[pa.Array]:
    """KEYS minwise hashes of each text's shingles, by which most near copies agree at least once; and the text."""
    out = []
    odd = np.random.default_rng(5).integers(1, 2**63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for text in texts:
        words = words_of((text or "").lower())
        shingles = {hash_of(" ".join(words[i : i + SHINGLE]).encode("utf-8", "surrogatepass")) for i in range(max(len(words) - SHINGLE + 1, 1))}
        mixed = np.fromiter(shingles, np.uint64, len(shingles))[:, None] * odd[None, :]
        out.append((mixed ^ (mixed >> np.uint64(31))).min(0).view(np.int64))
    return [pa.array(out, pa.list_(pa.int64())), pa.array([t or "" for t in texts], pa.string())]


def distinct_ids(rows: list) -> list[int]:
    """Of rows (doc_id, keys), the ids left when of all rows with one key at one place only the first stays, place by place."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    for i in range(KEYS):
        first: dict = {}
        for r in rows:
            first.setdefault(r["keys"][i], r)
        rows = list(first.values())
    return [r["doc_id"] for r in rows]


def choose_terms(counts: list, total: np.ndarray) -> tuple[dict, dict]:
    """Words and stems with their strengths, of rows (term, clean documents, toxic documents), that pass the test; stems that
    are no wider than a continuation go."""
    if not total.all():
        return {}, {}
    share, passed = total[1] / total.sum(), {}
    for term, n0, n1 in counts:
        n = n0 + n1
        odds = log((n1 + 0.5) / (total[1] + 1)) - log((n0 + 0.5) / (total[0] + 1))
        if n1 >= LEAST and odds > ODDS and 2 * (n1 * log(n1 / (n * share)) + (n0 and n0 * log(n0 / (n * (1 - share))))) > SURE:
            passed[term] = n1, min(odds, MOST_ODDS)
    widest: Counter = Counter()  # the most toxic documents of a stem's continuations, among the terms that passed
    for term, (n1, _) in passed.items():
        for n in range(STEM_FROM, len(term)):
            widest[term[:n]] = max(widest[term[:n]], n1)
    words = {t[:-1]: x for t, (_, x) in passed.items() if t.endswith(" ") and t[:-1] not in CLASSES}
    return words, {t: x for t, (n1, x) in passed.items() if not t.endswith(" ") and n1 >= WIDER * widest[t]}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most SAMPLE labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    picked = known.filter(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most SAMPLE rows of two numbers are sent to all tasks. The aggregation combines the rows of an id before its shuffle.
    found = map_texts(texts.join(F.broadcast(picked), "doc_id"), copy_keys, "keys array<long>, text string", ids=("doc_id", "toxic"))
    found = found.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("keys", "text"), F.xxhash64("text")).alias("d"))
    sample = stored(found.select("doc_id", "toxic", "d.text", "d.keys"), "toxicity")
    # At most SAMPLE rows of KEYS + 1 numbers.
    single = distinct_ids(sample.select("doc_id", "keys").collect())
    wanted = set(single)
    sums = [F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(2 * PARTS_OF_SAMPLE)]
    counts = sample.select("doc_id", "toxic", "text").mapInArrow(lambda x: term_counts(x, wanted), "term string, n array<long>").groupBy("term").agg(*sums)
    toxic = reduce(lambda a, b: a + b, (F.col(f"n{2 * i + 1}") for i in range(PARTS_OF_SAMPLE)))
    # Of the terms of at most SAMPLE documents, those of some toxic ones.
    rows = counts.filter((toxic >= LEAST) | F.col("term").isNull()).collect()
    if not rows:
        return Model({}, {}, PRIOR)
    table = np.array([r[1:] for r in rows], np.int64).reshape(-1, PARTS_OF_SAMPLE, 2)
    terms = [r["term"] for r in rows]
    at, named = terms.index(None), [i for i, t in enumerate(terms) if t is not None]

    def model_of(parts: list[int]) -> Model:
        n = table[:, parts].sum(1)
        return Model(*choose_terms([(terms[i], *n[i].tolist()) for i in named], n[at]), PRIOR)

    whole = model_of(list(range(PARTS_OF_SAMPLE)))
    if not table[at].sum(0).all():
        return whole
    others = [model_of([j for j in range(PARTS_OF_SAMPLE) if j != i]) for i in range(PARTS_OF_SAMPLE)]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            each = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            x = [(float(label), *text_features(t, others[part_of(i)].lexicon)) for i, label, t in each if i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in x], pa.float64()) for i in range(5)], list("yabcd"))

    # At most SAMPLE rows of five numbers.
    fit = np.array([tuple(r) for r in sample.select("doc_id", "toxic", "text").mapInArrow(of, "y double, a double, b double, c double, d double").collect()], float)
    return Model(whole.insults, whole.stems, logistic(fit[:, 1:], fit[:, 0]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = learn(docs, labels)
    scored = map_texts(docs, lambda texts: [pa.array(model.scores(texts), pa.float64())], "score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score_toxicity() predicts 0 for, with all their columns."""
    model = learn(docs, labels)
    return keep_rows(docs, lambda texts: (model.scores(texts) < 0.5).tolist())
