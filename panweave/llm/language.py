"""Language identification of web pages by Bayesian evidence fusion.

For each page and language: the likelihood of the text under a model of character trigrams, of the language that
the markup declares, and of the one that the address names (a path segment or the top-level domain), times a prior
of the page's host. Host priors are soft counts of the text's posteriors, smoothed towards the registered domain's,
which are smoothed towards all pages'; a page's own count is taken out. How far declarations and addresses can be
trusted is estimated from all pages in the same way. All counts are grouped aggregations over all pages.

Trigrams are counted in at most SAMPLE labelled documents of each language, those of the smallest hash, and the TRIGRAMS most
frequent ones of each language are kept: a rare language is learned as well as a frequent one. This is the only sample; it bounds
what goes to the driver.

Defined cases: null and empty pages have no text evidence and get the language of the other evidence, in the end
of the host or of all pages. A null address is a host of its own (""). Without labelled documents there are no
languages, and lang is null; labelled documents without an id aren't learned from. Ties go to the alphabetically first language. Empty tables give empty results.
Repeated rows are judged one by one. Other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panweave.llm.common import cut, sliced, stored

SAMPLE, TRIGRAMS, SMOOTH, TEMPER = 1000, 10_000, 0.5, 200
#: How many times SAMPLE ids are looked at to find the first ones; more than one, as ids may be repeated.
SPARE = 4
#: Soft counts with which a host leans on its domain, a domain on all pages, and evidence on being right.
LEAN, TRUST, OTHER = 5.0, 20.0, "other"

# Elements that aren't running text; second labels under which countries register domains; languages of countries.
HIDDEN = {"script", "style", "nav", "header", "footer", "noscript"}
SECOND = {"ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "ne", "net", "or", "org"}
COUNTRIES = {
    "ar": "es", "at": "de", "au": "en", "bo": "es", "br": "pt", "cl": "es", "cn": "zh", "co": "es", "cr": "es", "cz": "cs", "de": "de", "dk": "da", "ec": "es",
    "es": "es", "fr": "fr", "gr": "el", "gt": "es", "hu": "hu", "ie": "en", "il": "he", "in": "hi", "ir": "fa", "it": "it", "jp": "ja", "kr": "ko", "li": "de", "mx": "es",
    "nl": "nl", "no": "no", "nz": "en", "pe": "es", "pl": "pl", "pt": "pt", "py": "es", "ro": "ro", "ru": "ru", "se": "sv", "tr": "tr", "ua": "uk", "uk": "en", "us": "en",
    "uy": "es", "ve": "es",
}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>|<[^<>]*>")
AD = re.compile(r"\bclass\s*=\s*[\"']?ad\b", re.I)
LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})\b")
CONTENT = re.compile(r"(?i)\bcontent\s*=\s*[\"']?([a-z]{2,3})\b")
LETTERS = re.compile(r"[\W\d_]+")


def visible(page: str | None) -> str:
    """The running text of a page, in one pass: what no closing tag has been found for once isn't searched for again."""
    page, out, at, missing = page or "", [], 0, set()
    low = page.lower()
    low = low if len(low) == len(page) else "".join(c.lower() if c.isascii() else c for c in page)
    while (start := page.find("<", at)) >= 0:
        out += (page[at:start], " ")
        at, end = start + 1, None
        if page.startswith("<!--", start):
            end = "-->"
        elif found := TAG.match(page, start):
            at = found.end()
            name = (found[2] or "").lower()
            if not found[1] and (name in HIDDEN or (name == "div" and AD.search(found[3]))):
                end = f"</{name}"
        else:
            out.append("<")
        if end and end not in missing:
            if (stop := low.find(end, at)) < 0:
                missing.add(end)
            else:
                at = stop + len(end)
                if end != "-->" and (found := TAG.match(page, stop)):
                    at = found.end()
    return html.unescape("".join([*out, page[at:]]))


def declared(page: str | None) -> str | None:
    """The language that the root element names, else that of a content-language element."""
    meta = None
    for found in TAG.finditer(page or ""):
        name = (found[2] or "").lower()
        if name == "html" and not found[1] and (lang := LANG.search(found[3])):
            return lang[1].lower()
        if name == "meta" and meta is None and "content-language" in found[3].lower() and (lang := CONTENT.search(found[3])):
            meta = lang[1].lower()
    return meta


def address(url: str | None, languages: list[str]) -> tuple[str, str, str | None]:
    """Host, registered domain and the language that the address names: a part of the path, the first label of the host, or its
    last one, which may be a language or a country."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", "", None
    labels = host.split(".")
    known = set(languages)
    named = next((x for x in parts.path.lower().split("/")[1:3] if x in known), None)
    if named is None and len(labels) > 2 and labels[0] in known:
        named = labels[0]
    if named is None:
        named = next((x for x in (COUNTRIES.get(labels[-1]), labels[-1]) if x in known), None)
    return host, ".".join(labels[-3 if len(labels[-1]) == 2 and labels[-2:-1] and labels[-2] in SECOND else -2 :]), named


def trigrams(text: str) -> Counter:
    """Counts of the trigrams of a text's words, each with a space on either side."""
    words = Counter(LETTERS.sub(" ", text.lower()).split())
    out: Counter = Counter()
    for word, n in words.items():
        padded = f" {word} "
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] += n
    return out


class TextModel:
    """Log-likelihoods of trigrams by language."""

    def __init__(self, languages: list[str], counts: dict[str, list[float]]):
        self.languages = languages
        table = np.array([counts[g] for g in counts], float).reshape(len(counts), len(languages)) + SMOOTH
        totals = table.sum(0) + SMOOTH
        self.rows = {g: i for i, g in enumerate(counts)}
        self.logs = np.log(table / totals)
        self.kept: dict[str, np.ndarray] = {}

    def word(self, word: str) -> np.ndarray:
        if (known := self.kept.get(word)) is None:
            rows = [self.rows[g] for i in range(len(word)) if (g := f" {word} "[i : i + 3]) in self.rows]
            known = np.append(self.logs[rows].sum(0), len(rows))
            if len(self.kept) > 100_000:
                self.kept.clear()
            self.kept[word] = known
        return known

    def posterior(self, text: str) -> np.ndarray:
        """Probabilities of the languages by the text alone. Trigrams overlap and repeat, so they count as TEMPER at most."""
        words = LETTERS.sub(" ", text.lower()).split()
        sums = np.zeros(len(self.languages) + 1)
        for word, n in Counter(words).items():
            sums += n * self.word(word)
        logs, n = sums[:-1], sums[-1]
        if not n:
            return np.full(len(self.languages), 1 / max(len(self.languages), 1))
        logs = logs * min(1, TEMPER / n)
        p = np.exp(logs - logs.max())
        return p / p.sum()


def learn(docs: DataFrame) -> TextModel:
    """A text model from at most SAMPLE labelled documents (text, lang) of each language."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang")).alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    # Some SPARE times SAMPLE ids of each language come below its bound, however many documents it has; of these the first count.
    sizes = cut(known.groupBy("lang").agg(F.count("*").alias("size")))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    low = known.select("lang", "doc_id").join(sizes, "lang").filter(place <= F.lit(float(SPARE * SAMPLE << 40)) / F.col("size")).select("lang", "doc_id").distinct()
    first = Window.partitionBy("lang").orderBy(place, "doc_id")
    picked = low.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= SAMPLE).select("lang", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(trigrams(text))
            rows = [(lang, g, n) for lang, c in by_lang.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    # At most SAMPLE ids of each language are broadcast. A language's texts with one id count as one document's.
    texts = known.join(F.broadcast(picked), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    counts = cut(texts.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("at", F.row_number().over(most)).filter(F.col("at") <= TRIGRAMS).select("gram").distinct()
    grouped = counts.join(F.broadcast(best), "gram", "left_semi").groupBy("gram").agg(F.collect_list(F.struct("lang", "n")).alias("by"))
    rows = sorted(grouped.collect())  # TRIGRAMS rows for each language at most
    languages = sorted({x["lang"] for r in rows for x in r["by"]})
    return TextModel(languages, {r["gram"]: [next((x["n"] for x in r["by"] if x["lang"] == lang), 0) for lang in languages] for r in rows})


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, domain, declared, named and p (posteriors by the text) of every page."""
    languages = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sites = [address(u, languages) for u in batch.column(1).to_pylist()]
            said, posts = [], []
            for page in batch.column(2).to_pylist():
                lang = declared(page)
                said.append(lang if lang is None or lang in languages else OTHER)
                posts.append(model.posterior(visible(page)))
            columns = [pa.array([s[i] for s in sites], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:2], pa.array(said, pa.string()), columns[2], pa.array(posts, pa.list_(pa.float64()))], ["page_id", "host", "domain", "declared", "named", "p"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, host string, domain string, declared string, named string, p array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, named and host of every page."""
    model = learn(docs)
    languages, n = model.languages, len(model.languages)
    if not n:
        empty = F.lit(None).cast("string")
        return evidence(pages, model).select("page_id", empty.alias("lang"), F.lit(0.0).alias("confidence"), empty.alias("text_lang"), "declared", "named", "host")
    found = stored(evidence(pages, model), "language")
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(n)]
    total = found.agg(F.count("*").alias("n"), *sums).first()
    everywhere = [((total[f"s{i}"] or 0.0) + 1) / (total["n"] + n) for i in range(n)]

    def trust(column: str) -> list:
        """P(evidence | language) for each language, as columns; evidence that is missing says nothing."""
        rows = {r[column]: r for r in found.filter(F.col(column).isNotNull()).groupBy(column).agg(*sums).collect()}  # a row for each language and OTHER
        values = [*languages, OTHER]
        out = []
        for i, lang in enumerate(languages):
            counts = {v: (rows[v][f"s{i}"] if v in rows else 0.0) + TRUST * (0.9 if v == lang else 0.1 / n) for v in values}
            whole = sum(counts.values())
            out.append(reduce(lambda e, v: e.when(F.col(column) == v, F.lit(counts[v] / whole)), values, F.when(F.lit(False), F.lit(1.0))).otherwise(1.0))  # noqa: B023
        return out

    hosts = found.groupBy("domain", "host").agg(F.count("*").alias("n"), *sums)
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    # Stored, so that both sides of the next join are dealt by it alone, and a hot host's part can be split.
    priors = cut(hosts.join(domains, "domain"))
    each = found.join(priors, ["domain", "host"])
    # The page's own posteriors are taken out of its host's and domain's counts.
    of_domain = [(F.col(f"d{i}") - F.col("p")[i] + LEAN * everywhere[i]) / (F.col("dn") - 1 + LEAN) for i in range(n)]
    of_host = [(F.col(f"s{i}") - F.col("p")[i] + LEAN * of_domain[i]) / (F.col("n") - 1 + LEAN) for i in range(n)]
    said, named = trust("declared"), trust("named")
    joint = F.array(*(F.greatest(of_host[i], F.lit(1e-9)) * F.greatest(F.col("p")[i], F.lit(1e-12)) * said[i] * named[i] for i in range(n)))
    each = each.withColumn("joint", joint).withColumn("best", F.array_max("joint"))
    whole = F.aggregate("joint", F.lit(0.0), lambda a, x: a + x)
    names = F.array(*(F.lit(x) for x in languages))
    pick = lambda values, top: F.element_at(names, F.array_position(values, top).cast("int"))
    return each.select("page_id", pick(F.col("joint"), F.col("best")).alias("lang"), (F.col("best") / whole).alias("confidence"), pick(F.col("p"), F.array_max("p")).alias("text_lang"), "declared", "named", "host")
