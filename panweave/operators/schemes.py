"""Search schemes: how many errors each part of a read may have, in which order the parts are searched.

A scheme for k errors cuts a read into parts and lists searches: an order of the parts, and lower and upper bounds on
the errors made after each of them. A scheme is complete if every way to spread up to k errors over the parts obeys
the bounds of some search.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Search:
    order: tuple[int, ...]
    lower: tuple[int, ...]
    upper: tuple[int, ...]

    @property
    def directions(self) -> tuple[int, ...]:
        """1 for a part to the right of what has been searched, -1 to the left; the first as the second."""
        later = tuple(1 if b > a else -1 for a, b in zip(self.order, self.order[1:], strict=False))
        return (later[0] if later else 1, *later)

    @property
    def exact_parts(self) -> int:
        """Leading parts without errors."""
        return next((i for i, u in enumerate(self.upper) if u), len(self.upper))

    def faults(self, parts: int) -> list[str]:
        out = []
        if sorted(self.order) != list(range(parts)):
            out.append("order")
        elif any(max(self.order[:i]) - min(self.order[:i]) != i - 1 for i in range(1, parts + 1)):
            out.append("connectivity")
        if any(list(x) != sorted(x) for x in (self.lower, self.upper)):
            out.append("decreasing bounds")
        if len(self.lower) != parts or len(self.upper) != parts or any(a > b for a, b in zip(self.lower, self.upper, strict=False)):
            out.append("bounds")
        return out

    def covers(self, pattern: tuple[int, ...]) -> bool:
        made = 0
        for part, low, high in zip(self.order, self.lower, self.upper, strict=True):
            made += pattern[part]
            if not low <= made <= high:
                return False
        return True


# Published search schemes, a line for each search: order, lower and upper bounds.
TABLES = {
    ("kuch_k+1", 1): "01 00 01, 10 00 01",
    ("kuch_k+1", 2): "012 000 022, 210 000 012, 102 001 012",
    ("kuch_k+1", 3): "0123 0000 0133, 1023 0011 0133, 2310 0000 0133, 3210 0011 0133",
    ("kuch_k+1", 4): "01234 00000 02244, 43210 00000 01344, 10234 00133 01344, 01234 00133 01344, 32410 00011 01244, 21034 00013 01244, 10234 00124 01244, 01234 00034 00444",
    ("kuch_k+2", 1): "012 000 011, 120 000 001",
    ("kuch_k+2", 2): "0123 0000 0112, 3210 0000 0122, 1230 0001 0012, 0123 0002 0022",
    ("kuch_k+2", 3): "01234 00000 01233, 12340 00000 01223, 23410 00001 01133, 34210 00012 00333",
    ("kuch_k+2", 4): "012345 000000 012344, 123450 000000 012344, 543210 000001 012244, 345210 000012 011344, 234510 000023 011244, "
    "453210 000133 003344, 012345 000333 003344, 012345 000044 002444, 231045 000124 002244, 453210 000044 001444",
    ("kianfar", 1): "01 00 01, 10 00 01",
    ("kianfar", 2): "012 002 012, 210 000 022, 120 011 012",
    ("kianfar", 3): "0123 0003 0233, 1230 0000 1233, 2310 0022 0033",
    ("kianfar", 4): "01234 00004 03344, 12340 00000 22334, 43210 00033 00444",
    ("manbest", 4): "012345 000004 033344, 123450 000000 022334, 213450 011111 022334, 321450 012222 012334, 543210 000033 004444",
    ("kuch_k+1_adapted", 1): "01 01 01, 10 00 01",
    ("kuch_k+1_adapted", 2): "012 012 022, 210 000 012, 102 001 012",
    ("kuch_k+1_adapted", 3): "0123 0002 0133, 1023 0113 0133, 2310 0000 0133, 3210 0111 0133",
    ("kuch_k+1_adapted", 4): "01234 00002 02244, 43210 00000 01344, 10234 01334 01334, 01234 00334 01334, 32410 00111 01244, 21034 00113 01244, 10234 01224 01244, 01234 00344 00444",
    ("kuch_k+2_adapted", 1): "012 001 011, 120 000 001",
    ("kuch_k+2_adapted", 2): "0123 0000 0112, 3210 0012 0122, 1230 0001 0012, 0123 0022 0022",
    ("kuch_k+2_adapted", 3): "01234 00003 01233, 12340 00000 01223, 23410 00011 01133, 34210 00122 00333",
    ("kuch_k+2_adapted", 4): "012345 001113 012344, 123450 000000 012344, 543210 000011 012244, 345210 001122 011344, 234510 011234 011244, "
    "453210 000334 003344, 012345 000333 003344, 012345 000044 002444, 231045 001224 002244, 453210 000444 001444",
    ("01star0_adapted", 4): "012345 000004 012444, 123450 000033 012334, 234510 000222 012244, 345210 001111 011444, 453210 000000 003444",
    ("01star0_adapted", 5): "0123456 0000004 0123555, 1234560 0000045 0124445, 2345610 0000333 0123355, 3456210 0002222 0122555, 4563210 0011111 0115555, 5643210 0000000 0035555",
    ("pigeon", 3): "0123 0000 0333, 1023 0000 0333, 2310 0000 0333, 3210 0000 0333",
    ("pigeon_adapted", 3): "0123 0000 0333, 1023 0000 0333, 2310 0000 0333, 3210 0000 0333",
    ("pigeon_adapted", 4): "01234 00002 01344, 12340 00011 01334, 23410 00000 01244, 34210 00123 01444, 43210 01234 02344",
    ("pigeon_adapted", 5): "012345 000001 012555, 234510 000112 013355, 123450 000023 013445, 453210 001234 014555, 345210 000000 012555, 543210 012345 023555",
}
# Begins of the parts as fractions of the read, where they aren't even.
STATIC = {
    ("01star0", 1): "0.50 0.96", ("01star0", 2): "0.26 0.64 0.83", ("01star0", 3): "0.22 0.46 0.67 0.95", ("01star0", 4): "0.19 0.37 0.57 0.74 0.96",
    ("kianfar", 1): "0.5", ("kianfar", 2): "0.30 0.60", ("kianfar", 3): "0.17 0.69 0.96", ("kianfar", 4): "0.2 0.5 0.6 0.8",
    ("kuch_k+1", 1): "0.5", ("kuch_k+1", 2): "0.41 0.7", ("kuch_k+1", 3): "0.25 0.50 0.75", ("kuch_k+1", 4): "0.27 0.47 0.62 0.81",
    ("kuch_k+2", 1): "0.47 0.94", ("kuch_k+2", 2): "0.35 0.50 0.65", ("kuch_k+2", 3): "0.22 0.44 0.66 0.88", ("kuch_k+2", 4): "0.18 0.37 0.53 0.69 0.83",
    ("kuch_k+1_adapted", 3): "0.25 0.50 0.76", ("kuch_k+1_adapted", 4): "0.25 0.44 0.61 0.81", ("manbest", 4): "0.24 0.43 0.62 0.73 0.77",
}
LARGEST = {"01star0": 5, "01star0_adapted": 5, "pigeon": 5, "pigeon_adapted": 5}
NAMES = ("01star0", "01star0_adapted", "kianfar", "kuch_k+1", "kuch_k+1_adapted", "kuch_k+2", "kuch_k+2_adapted", "manbest", "pigeon", "pigeon_adapted")
DEFAULT = "kuch_k+1"


def _outwards(first: int, parts: int) -> tuple[int, ...]:
    return (*range(first, parts), *range(first - 1, -1, -1))


def searches(name: str, k: int) -> list[Search]:
    """A built-in scheme for k errors."""
    if (text := TABLES.get((name, k))) is not None:
        return [Search(*(tuple(map(int, x)) for x in line.split())) for line in text.split(", ")]
    if name.startswith("01star0") and 1 <= k <= 5:
        p = k + 2  # an exact part, then one with at most one error; the last search has two exact parts
        return [Search(_outwards(i, p), (0,) * p, (0, 0 if i == k else 1, *(k,) * (p - 2))) for i in range(k + 1)]
    if name.startswith("pigeon") and 1 <= k <= 5:
        p = k + 1  # one exact part
        return [Search(_outwards(i, p), (0,) * p, (0, *(k,) * (p - 1))) for i in range(p)]
    raise ValueError(f"scheme {name} has no searches for {k} errors")


def supported() -> list[tuple[str, int]]:
    return [(n, k) for n in NAMES for k in ([4] if n == "manbest" else range(1, LARGEST.get(n, 4) + 1))]


def static_begins(name: str, k: int) -> list[float]:
    """Begins of all parts but the first, as fractions."""
    parts = len(searches(name, k)[0].order)
    text = STATIC.get((name, k)) or STATIC.get((name.removesuffix("_adapted"), k))
    return list(map(float, text.split())) if text else [i / parts for i in range(1, parts)]


def patterns(parts: int, k: int) -> Iterable[tuple[int, ...]]:
    """All ways to spread up to k errors over the parts."""
    for bars in combinations(range(parts + k), parts):
        yield tuple(b - a - 1 for a, b in zip((-1, *bars), bars, strict=False))


def validate(scheme: list[Search], k: int) -> list[str]:
    """What is wrong with a scheme; nothing if it is sound and complete."""
    if not scheme:
        return ["no searches"]
    parts = len(scheme[0].order)
    out = [f"search {i}: {fault}" for i, s in enumerate(scheme) for fault in s.faults(parts)]
    if not out:
        missed = [p for p in patterns(parts, k) if not any(s.covers(p) for s in scheme)]
        out += [f"uncovered: {p}" for p in missed]
    return out


def parse_search(line: str) -> Search:
    found = re.findall(r"\{([^}]*)\}", line)
    if len(found) != 3:
        raise ValueError(f"a search needs an order and two rows of bounds: {line!r}")
    order, lower, upper = (tuple(int(x) for x in part.split(",")) for part in found)
    if not len(order) == len(lower) == len(upper):
        raise ValueError(f"order and bounds differ in length: {line!r}")
    return Search(order, lower, upper)


@dataclass(frozen=True)
class CustomScheme:
    name: str
    searches: dict[int, list[Search]]
    begins: dict[int, list[float]]
    seeds: dict[int, list[float]]
    weights: dict[int, list[int]]


def read_scheme(folder: str) -> CustomScheme:
    """A scheme folder: name.txt, and for each k a folder with searches.txt and perhaps partitioning files."""
    text = lambda *p: open(os.path.join(folder, *p)).read()  # noqa: E731, SIM115
    out = CustomScheme(text("name.txt").strip(), {}, {}, {}, {})
    for k in range(1, 6):
        if not os.path.exists(os.path.join(folder, str(k), "searches.txt")):
            continue
        out.searches[k] = [parse_search(x) for x in text(str(k), "searches.txt").splitlines() if x.strip()]
        if faults := validate(out.searches[k], k):
            raise ValueError(f"scheme for {k} errors: {'; '.join(faults[:5])}")
        parts = len(out.searches[k][0].order)
        if os.path.exists(os.path.join(folder, str(k), "static_partitioning.txt")):
            out.begins[k] = fractions(text(str(k), "static_partitioning.txt").split(), parts - 1)
        if os.path.exists(os.path.join(folder, str(k), "dynamic_partitioning.txt")):
            seeds, weights = text(str(k), "dynamic_partitioning.txt").splitlines()[:2]
            out.seeds[k] = fractions(seeds.split(), parts - 2)
            out.weights[k] = [int(x) for x in weights.split()]
            if len(out.weights[k]) != parts:
                raise ValueError(f"{parts} weights are needed")
    if not out.searches:
        raise ValueError("no searches found")
    return out


def fractions(values: list, n: int) -> list[float]:
    """Exactly n rising numbers between 0 and 1."""
    got = [float(x) for x in values]
    if len(got) != n or any(not 0 < x < 1 for x in got) or got != sorted(set(got)):
        raise ValueError(f"{n} rising fractions between 0 and 1 are needed, not {values}")
    return got


def scheme_table(spark: SparkSession) -> DataFrame:
    """scheme, k, search_no, ord, lo, hi (arrays) of all built-in schemes."""
    rows = [(n, k, i, list(s.order), list(s.lower), list(s.upper)) for n, k in supported() for i, s in enumerate(searches(n, k))]
    return spark.createDataFrame(rows, "scheme string, k int, search_no int, ord array<int>, lo array<int>, hi array<int>")


def coverage(table: DataFrame) -> DataFrame:
    """scheme, k, parts, searches, patterns, covered, covered_twice, by joining patterns with searches."""
    sizes = table.groupBy("scheme", "k").agg(F.max(F.size("ord")).alias("parts"), F.count("*").alias("searches"))
    spread = sizes.select("scheme", "k", "parts", "searches", F.array().cast("array<int>").alias("pattern"))
    for part in range(7):  # no scheme has more parts
        grown = F.explode(F.sequence(F.lit(0), F.col("k") - F.aggregate("pattern", F.lit(0), lambda a, x: a + x)))
        more = spread.filter(F.col("parts") > part).withColumn("e", grown).withColumn("pattern", F.concat("pattern", F.array("e"))).drop("e")
        spread = more.unionByName(spread.filter(F.col("parts") <= part))
    sums = F.transform("ord", lambda _, i: F.aggregate(F.slice(F.col("ord"), 1, i + 1), F.lit(0), lambda a, p: a + F.element_at(F.col("pattern"), p + 1)))
    ok = F.forall(F.zip_with("made", F.arrays_zip("lo", "hi"), lambda m, b: (m >= b["lo"]) & (m <= b["hi"])), lambda x: x)
    held = spread.join(table, ["scheme", "k"]).withColumn("made", sums).withColumn("ok", ok.cast("int"))
    by_pattern = held.groupBy("scheme", "k", "parts", "searches", "pattern").agg(F.sum("ok").alias("n"))
    return by_pattern.groupBy("scheme", "k", "parts", "searches").agg(
        F.count("*").alias("patterns"), F.sum((F.col("n") > 0).cast("long")).alias("covered"), F.sum((F.col("n") > 1).cast("long")).alias("covered_twice")
    )


def uniform_parts(length, parts: int):
    """Column: array of (part, begin, end) of even parts of a read."""
    return F.array(*(F.struct(F.lit(i).alias("part"), F.floor(length * i / parts).cast("int").alias("begin"), (F.floor(length * (i + 1) / parts) if i + 1 < parts else length).cast("int").alias("end")) for i in range(parts)))


def static_parts(length, begins: list[float]):
    """Column: array of (part, begin, end) with begins at fractions of the read."""
    at = [F.lit(0), *(F.floor(length * f).cast("int") for f in begins), length.cast("int")]
    return F.array(*(F.struct(F.lit(i).alias("part"), at[i].cast("int").alias("begin"), at[i + 1].cast("int").alias("end")) for i in range(len(begins) + 1)))
