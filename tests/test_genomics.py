"""The graph, matching, schemes and walks against plain versions on small inputs."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from panweave.operators import junctions, matching, packed_index, paths, ranking, schemes, sequences, subgraph, text_index, walks
from panweave.operators.graph import Graph, maximal

TOY = {0: "ACGTACGGTTACGATTACAGGACT", 1: "ACGTACGGTTCCGATTACAGGACG", 2: "ACGTACGGTTACGATTTACAGGAAA"}
TAILS = {0: "AACCGGTTA", 1: "TTCCGGTTA"}
TWIN = {0: "ACGTTGCA", 1: "ACGTTGCA"}
SHORT = {0: "ACGTTGCA", 1: "AC"}


def table(spark, strains):
    return spark.createDataFrame([(i, s, len(s)) for i, s in strains.items()], "strain long, seq string, len long")


def plain_graph(strains, k):
    """Segments of each strain by walking it: [(omega, kind)] with the end node last."""
    following, preceding = {}, {}
    first = min(strains)
    for i, s in strains.items():
        for p in range(len(s) - k + 1):
            g = s[p : p + k]
            following.setdefault(g, set()).add(s[p + k] if p + k < len(s) else f"%{i}")
            preceding.setdefault(g, set()).add(s[p - 1] if p else "$" if i == first else "%")
    out = {}
    for i, s in strains.items():
        start, segments = 0, []
        for p in range(len(s) - k + 1):
            right = len(following[s[p : p + k]]) > 1
            left = p + k < len(s) and len(preceding[s[p + 1 : p + k + 1]]) > 1
            if right or left:
                segments.append((s[start : p + k], "right_maximal" if right else "pre_left_maximal"))
                start = p + 1
        out[i] = [*segments, (s[start:] + "%", "end")]
    return out


@pytest.mark.parametrize(("strains", "k"), [(TOY, 4), (TOY, 6), (TAILS, 4), (TWIN, 4)])
def test_graph(spark, strains, k):
    graph, plain = Graph(table(spark, strains), k), plain_graph(strains, k)
    nodes = {r["node_id"]: r for r in graph.nodes.collect()}
    occ = graph.node_occ.orderBy("strain", "seg_ord").collect()
    got = {}
    for r in occ:
        got.setdefault(r["strain"], []).append((nodes[r["node_id"]]["omega"], r["kind"]))
    assert got == plain
    inner = [x for segs in plain.values() for x in segs if x[1] != "end"]
    assert sorted(nodes) == list(range(len(set(inner)) + len(strains)))
    assert {(n["omega"], n["kind"]): n["multiplicity"] for n in nodes.values() if n["kind"] != "end"} == {x: inner.count(x) for x in inner}
    rank = {"right_maximal": 0, "pre_left_maximal": 1, "end": 2}
    order = [(rank[n["kind"]], n["omega"][-k:] if n["kind"] != "end" else "") for _, n in sorted(nodes.items())]
    assert order == sorted(order)
    # Strains are spelled by their node paths; neighbours overlap by k - 1.
    for i, s in strains.items():
        text = ""
        for omega, _ in got[i]:
            assert not text or text[-(k - 1) :] == omega[: k - 1]
            text += omega[k - 1 :] if text else omega
        assert text == s + "%"
    stats = graph.stats().first()
    assert stats["n_nodes"] == len(nodes) and stats["n_edges"] == len(inner) == sum(r["multiplicity"] for r in graph.edges.collect())
    kmers = {r["kmer"]: (r["node_id"], r["offset"]) for r in graph.kmer_to_node().collect()}
    assert all(nodes[n]["omega"][o : o + k] == g for g, (n, o) in kmers.items())
    ahead = {(r["node_id"], r["character"], r["neighbour"]) for r in graph.neighbours(True).collect()}
    assert ahead == {(r["src"], nodes[r["dst"]]["omega"][k - 1], r["dst"]) for r in graph.edges.collect()}


def test_short_strain_has_only_an_end_node(spark):
    occ = Graph(table(spark, SHORT), 4).node_occ.filter("strain = 1").collect()
    assert [(r["kind"], r["seg_start"]) for r in occ] == [("end", 0)]


def test_one_long_strain(spark, monkeypatch):
    """A strain of many blocks and cells: nodes spell it, and their texts come from several blocks."""
    rng = random.Random(7)
    part = "".join(rng.choice("ACGT") for _ in range(300))
    strains = {0: part + "".join(rng.choice("ACGT") for _ in range(2500)) + part, 1: "ACGTTGCAACGG"}
    monkeypatch.setattr(sequences, "BLOCK", 64)
    monkeypatch.setitem(sequences.long_slices.__kwdefaults__, "width", 16)
    monkeypatch.setitem(ranking.earlier.__kwdefaults__, "width", 32)
    test_graph(spark, strains, 6)
    test_graph(spark, {0: strains[0][:640], 1: strains[0][2176:]}, 12)


def test_graph_by_small_cells_and_runs(spark, monkeypatch):
    """Strains over many cells, some without a cut; buckets and rows in many pieces."""
    for name, value in {"CELL_BITS": 8, "BUCKET": 64, "PIECE": 32, "CHUNK": 200, "ROW": 8, "RUN": 5}.items():
        monkeypatch.setattr(junctions, name, value)
    monkeypatch.setattr(sequences, "BLOCK", 64)
    rng = random.Random(11)
    part, long = ("".join(rng.choices("ACGT", k=n)) for n in (150, 1500))
    test_graph(spark, {5: part + long + part, 2: long[400:1300], 9: part[:100] + "ACGT", 7: "ACGTTGCAACGG"}, 11)
    test_graph(spark, {0: part * 3, 1: part[20:120], 3: "AAAAAAAAAAAAAAAAAAAAAAAAAAAA"}, 5)


def test_graph_by_parts(spark, monkeypatch):
    """Buckets and cells are worked on in parts, and no part shuffles all."""
    for name, value in {"CELL_BITS": 9, "BUCKET": 64, "ROUND": 2, "ROUNDS": 3, "CELL_ROUNDS": 2}.items():
        monkeypatch.setattr(junctions, name, value)
    monkeypatch.setattr(sequences, "BLOCK", 64)
    asked, rng = [], random.Random(12)
    for name in ("cuts", "cells"):
        made = getattr(junctions, name)
        monkeypatch.setattr(junctions, name, lambda *a, made=made, **part: asked.append(part) or made(*a, **part))
    part, long = ("".join(rng.choices("ACGT", k=n)) for n in (150, 1500))
    test_graph(spark, {5: part + long + part, 2: long[400:1300], 7: "ACGTTGCAACGG"}, 11)
    assert asked == [{"part": i, "parts": n} for n in (3, 2) for i in range(n)]


def test_kmer_to_node_needs_few_places(spark, monkeypatch):
    """The nodes alone: equal to the whole graph's, with at most two places of each node and one of each strain kept, however often a node
    occurs; strains over many cells, repeats, ends with and without a cut, equal strains and none of k bases among them."""
    kept, made = [], junctions.cuts

    def watched(*a, **b):
        out = made(*a, **b)
        kept.append(sum(len(junctions.unpacked(bytes(r["data"]))["rising"]) for r in out.filter(F.col("what") == junctions.CUTS).collect()))
        return out

    monkeypatch.setattr(junctions, "cuts", watched)
    rng = random.Random(13)
    part, long = ("".join(rng.choices("ACGT", k=n)) for n in (60, 700))
    changed = lambda s, n: "".join(rng.choice("ACGT") if i % n == n - 1 else c for i, c in enumerate(s))
    often = {i: changed(part, 9 + i % 5) for i in range(2, 30)} | {40: part, 41: part, 42: "ACG", 43: part[:30]}
    over = {5: part + long + part, 2: long[100:500], 9: long, 7: "ACGTTGCAACGG"}
    sizes = {"CELL_BITS": 8, "BUCKET": 64, "PIECE": 32, "CHUNK": 200, "ROW": 8, "RUN": 5}
    for strains, k, small in ((TOY, 4, {}), (TWIN, 4, {}), (often, 7, {}), (often, 4, sizes), (over, 11, sizes), ({0: part * 3, 3: "A" * 28}, 5, sizes)):
        for name, value in small.items():
            monkeypatch.setattr(junctions, name, value)
        monkeypatch.setattr(sequences, "BLOCK", 64)
        kept.clear()
        alone, whole = Graph(table(spark, strains), k, nodes_only=True), Graph(table(spark, strains), k)
        nodes = sorted(alone.nodes.collect())
        assert nodes == sorted(whole.nodes.collect())
        assert {(n["omega"], n["kind"]) for n in nodes} == {x for segs in plain_graph(strains, k).values() for x in segs}
        assert sorted(alone.kmer_to_node().collect()) == sorted(whole.kmer_to_node().collect())
        assert kept[0] <= 2 * len(nodes) + len(strains)
        if strains is often:
            assert 2 * kept[0] < kept[1]


@pytest.mark.parametrize(("odd", "k"), [("N", 5), ("", 33)])
def test_graph_of_other_letters_and_long_kmers(spark, odd, k):
    rng = random.Random(5)
    part = "".join(rng.choices("ACGT", k=70))
    test_graph(spark, {0: part + odd + "ACGTA", 1: "C" + part[:60] + odd + "T", 2: part[10:]}, k)


@pytest.mark.parametrize("k", [2, 4, 7])
def test_maximal_kmers(spark, k):
    strains = {3: "ACGTACGTTGCACGT", 8: "ACGTACGTTGCA", 9: "TTTTTTTTT", 12: "GCACGTACG"}
    sides = {True: {}, False: {}}
    for i, s in strains.items():
        for p in range(len(s) - k + 1):
            sides[True].setdefault(s[p : p + k], []).append(s[p + k] if p + k < len(s) else f"%{i}")
            sides[False].setdefault(s[p : p + k], []).append(s[p - 1] if p else "$" if i == 3 else "%")
    for right, found in sides.items():
        got = {r["kmer"]: (r["n"], r["n_sides"]) for r in maximal(table(spark, strains), k, right).collect()}
        assert got == {g: (len(x), len(set(x))) for g, x in found.items() if len(set(x)) > 1}


def test_texts_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 8)
    strains = {0: "ACGTACGGTTACGATTACAGGACTACGT", 1: "ACGTTGCA"}
    wanted = [(i, b, n) for i, s in strains.items() for b in range(len(s) + 1) for n in (1, 3, 8, 9, 17, 28) if b + n <= len(s) + 1]
    frame = spark.createDataFrame([(at, i, b, n) for at, (i, b, n) in enumerate(wanted)], "number long, strain long, begin long, size long")
    for width in (1, 4, 1024):
        got = {r["number"]: r["text"] for r in sequences.long_slices(frame, table(spark, strains), width=width).collect()}
        assert got == {at: strains[i][b : b + n] for at, (i, b, n) in enumerate(wanted)}


def test_stored_tables_of_long_rows_have_small_groups(spark):
    """A reader takes a whole group of long rows into one array."""
    import pyarrow.parquet as pq

    kept = ranking.stored(spark.range(0, 24, 1, 1).select(F.expr("cast(array_join(transform(sequence(1, 50000), i -> sha2(cast(id * 50000 + i as string), 256)), '') as binary)").alias("data")))
    groups = [pq.ParquetFile(x.removeprefix("file://")).metadata for x in kept.inputFiles()]
    sizes = [m.row_group(i).total_byte_size for m in groups for i in range(m.num_row_groups)]
    assert kept.count() == 24 and len(sizes) > 2 and max(sizes) <= 3 * ranking.GROUP
    ranking.drop(kept)


def test_earlier_rows(spark):
    rng = random.Random(3)
    rows = [(g, at, rng.choice([None, *range(20)])) for g in (0, 1) for at in rng.sample(range(200), 60)]
    got = {(r["g"], r["at"]): (r["_last"], r["_before"]) for r in ranking.earlier(spark.createDataFrame(rows, "g int, at long, v int"), ["g"], "at", "v", width=8).collect()}
    for g, at, _ in rows:
        before = [v for h, b, v in rows if h == g and b < at]
        assert got[g, at] == (max((v for v in before if v is not None), default=None), len(before))
    assert ranking.earlier(spark.createDataFrame([], "g int, at long, v int"), ["g"], "at", "v").isEmpty()


def test_redundant_positions_of_one_read(spark, monkeypatch):
    """All matches are one read's; runs end and begin anywhere, cells' ends included."""
    monkeypatch.setitem(ranking.earlier.__kwdefaults__, "width", 8)
    rng, k = random.Random(5), 2
    begins = sorted(rng.sample(range(600), 150))
    rows = [(1, 0, 0, b, rng.randint(6, 10), rng.randint(0, 2), rng.choice("ACGT") * 4) for b in begins]
    found = spark.createDataFrame(rows, "read_id long, rc int, strain long, begin long, length int, ed int, matched string")
    starts = spark.createDataFrame([(0, 1000)], "strain long, start long")
    kept = []
    for _, _, _, b, n, e, _ in rows:
        if not kept or b - kept[-1][0] > 2 * k:
            kept.append((b, e, n))
        elif (e, n) < kept[-1][1:]:
            kept[-1] = (b, e, n)
    got = matching.dedup_positions(found, starts, k).orderBy("begin").collect()
    assert [(r["begin"], r["ed"], r["length"]) for r in got] == kept and all(r["position"] == 1000 + r["begin"] for r in got)
    same = found.selectExpr("read_id", "rc", "strain", "begin", "length", "ed", "'ACGT' AS matched")
    assert matching.dedup_positions(same, starts, k).count() == len(rows)


def test_windows_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK", 7)
    rng = random.Random(1)
    strains = {i: "".join(rng.choices("ACGT", k=n)) for i, n in enumerate((4, 5, 7, 8, 11, 14, 15, 40))}
    got = {tuple(r) for r in sequences.windows(table(spark, strains), 4, neighbours=True).collect()}
    want = set()
    for i, s in strains.items():
        for p in range(len(s) - 3):
            want.add((i, p, s[p : p + 4], ord(s[p - 1] if p else "$" if i == 0 else "%"), ord(s[p + 4]) if p + 4 < len(s) else -i - 1))
    assert got == want
    asked = spark.createDataFrame([(i, b, n) for i, s in strains.items() for b in range(len(s)) for n in (1, 5, 9)], "strain long, begin long, size int")
    assert all(r["text"] == strains[r["strain"]][r["begin"] : r["begin"] + r["size"]] for r in sequences.slices(asked, table(spark, strains), 9).collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        up, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(up[j] + (x != y), up[j + 1] + 1, row[j] + 1))
    return row[-1]


def all_matches(reads, strains, k, edit):
    out = set()
    for (i, rc), read in reads.items():
        for s, text in strains.items():
            for b in range(len(text)):
                for n in range(max(len(read) - k, 1), len(read) + k + 1) if edit else [len(read)]:
                    if b + n <= len(text):
                        ed = distance(text[b : b + n], read) if edit else sum(x != y for x, y in zip(text[b : b + n], read, strict=True))
                        if ed <= k:
                            out.add((i, rc, s, b, n, ed))
    return out


@pytest.fixture(scope="module")
def mapping():
    rng = random.Random(8)
    base = "".join(rng.choices("ACGT", k=90))
    strains = {0: base, 1: base[:40] + "T" + base[42:], 2: "".join(rng.choices("ACG", k=70))}
    reads = {}
    for i in range(8):
        text = strains[i % 3]
        at = rng.randrange(len(text) - 30)
        read = list(text[at : at + 30])
        for _ in range(i % 4):
            place = rng.randrange(len(read))
            read[place : place + 1] = rng.choice([["A"], ["C", "G"], []])
        reads[(i, 0)] = "".join(read)
    reads |= {(i, 1): s[::-1].translate(str.maketrans("ACGT", "TGCA")) for (i, _), s in reads.items()}
    return reads, strains


def read_table(spark, reads):
    return spark.createDataFrame([(i, rc, s) for (i, rc), s in reads.items()], "read_id long, rc int, seq string")


@pytest.mark.parametrize(("scheme", "k", "partition"), [("pigeon", 2, "uniform"), ("kuch_k+1", 2, "static"), ("kuch_k+2", 2, "static"), ("kianfar", 2, "static"), ("01star0", 2, "uniform"), ("kianfar", 3, "uniform"), ("pigeon", 0, "uniform")])
def test_edit_matches(spark, mapping, scheme, k, partition):
    reads, strains = mapping
    found = matching.edit_occurrences(read_table(spark, reads), table(spark, strains), k, scheme, partition=partition)
    assert {tuple(r)[:6] for r in found.collect()} == all_matches(reads, strains, k, True)


def test_hamming_exact_and_naive(spark, mapping):
    reads, strains = mapping
    t, r = table(spark, strains), read_table(spark, reads)
    assert {tuple(x)[:6] for x in matching.hamming_occurrences(r, t, 2).collect()} == all_matches(reads, strains, 2, False)
    assert {tuple(x)[:6] for x in matching.exact_occurrences(r, t).collect()} == all_matches(reads, strains, 0, False)
    short = {(0, 0): "ACGTA", (1, 0): "C", (2, 0): "GG"}
    naive = matching.naive_edit_occurrences(read_table(spark, short), t, 1)
    assert {tuple(x)[:6] for x in naive.collect()} == all_matches(short, strains, 1, True)


SHORT_READS = {(i, 0): s for i, s in enumerate(["ACGTACGGTT", "ACG", "C", "GG", "TACGATTACAGG", "ACGTA", "TTTTTTTTT"])}


@pytest.mark.parametrize(("scheme", "k", "partition"), [("pigeon", 2, "uniform"), ("pigeon", 3, "uniform"), ("01star0", 1, "uniform"), ("kuch_k+2", 2, "static"), ("kuch_k+1_adapted", 4, "static")])
def test_short_reads(spark, scheme, k, partition):
    """Reads shorter than any seed, or with fewer bases than the scheme has parts, lose no match."""
    strains = {0: TOY[0] + "CCGT", 1: "GGCATTA"}
    r, t = read_table(spark, SHORT_READS), table(spark, strains)
    assert {tuple(x)[:6] for x in matching.edit_occurrences(r, t, k, scheme, partition=partition).collect()} == all_matches(SHORT_READS, strains, k, True)
    assert {tuple(x)[:6] for x in matching.hamming_occurrences(r, t, k, scheme).collect()} == all_matches(SHORT_READS, strains, k, False)


def test_choices(spark, mapping):
    reads, strains = mapping
    t, r = table(spark, strains), read_table(spark, reads)
    for metric, k in (("edit", 1), ("hamming", 1), ("edit", 0)):
        assert {tuple(x)[:6] for x in matching.occurrences(r, t, k, metric).collect()} == all_matches(reads, strains, k, metric == "edit" and k > 0)
    for bad in (lambda: matching.occurrences(r, t, 1, "other"), lambda: matching.edit_occurrences(r, t, 6), lambda: matching.hamming_occurrences(r, t, -1), lambda: walks.check_choice("hamming", "uniform"), lambda: walks.check_choice("edit", "dynamic")):
        with pytest.raises(ValueError):
            bad()


def test_cigars(spark, mapping):
    import re

    reads, strains = mapping
    r = read_table(spark, reads)
    found = matching.with_cigars(matching.edit_occurrences(r, table(spark, strains), 2, "pigeon"), r).collect()
    assert found
    for x in found:
        read, cost, out, at = reads[x["read_id"], x["rc"]], 0, "", 0
        for n, op in re.findall(r"(\d+)([=XID])", x["cigar"]):
            n = int(n)
            part = x["matched"][at : at + n] if op != "I" else ""
            own = read[len(out) : len(out) + n] if op != "D" else ""
            assert (op != "=" or part == own) and (op != "X" or all(a != b for a, b in zip(part, own, strict=True)))
            at, out, cost = at + len(part), out + own, cost + n * (op != "=")
        assert out == read and at == len(x["matched"]) and cost == x["ed"]
    assert matching.cigar("", "AC") == "2I" and matching.cigar("ACGT", "ACGT") == "4=" and matching.cigar("ACG", "AG") == "1=1D1="


def plain_fold(items, k):
    kept = []
    for x in sorted(items):
        if kept and x[0] - kept[-1][0] <= 2 * k:
            if (x[1], x[2]) < (kept[-1][1], kept[-1][2]):
                kept[-1] = x
        else:
            kept.append(x)
    return kept


def test_redundant_positions(spark, mapping):
    reads, strains = mapping
    k = 2
    found = matching.edit_occurrences(read_table(spark, reads), table(spark, strains), k, "pigeon")
    starts = sequences.with_starts(table(spark, strains))
    got = {}
    for r in matching.dedup_positions(found, starts, k).collect():
        got.setdefault((r["read_id"], r["rc"]), []).append((r["position"], r["ed"], r["length"]))
    begin = {0: 0, 1: 91, 2: 91 + len(strains[1]) + 1}
    want = {}
    for key, read in reads.items():
        all_ = [m for m in all_matches({key: read}, strains, k, True)]
        best = {}
        for m in all_:
            best[m[2], m[3]] = min(best.get((m[2], m[3]), (9, 9)), (m[5], m[4]))
        items = [(begin[s] + b, *v) for (s, b), v in best.items()]
        strings = {strains[m[2]][m[3] : m[3] + m[4]] for m in all_}
        if items:
            want[key] = sorted(items) if len(strings) == 1 else plain_fold(items, k)
    assert {key: sorted(v) for key, v in got.items()} == want


def test_paths_strains_and_sets(spark, monkeypatch):
    monkeypatch.setattr(paths, "BUCKET", 5)
    graph = Graph(table(spark, TOY), 4)
    plain = plain_graph(TOY, 4)
    ids = {(r["omega"], r["kind"]): r["node_id"] for r in graph.nodes.filter("kind <> 'end'").collect()}
    ends = {r["strain"]: r["node_id"] for r in graph.node_occ.filter("kind = 'end'").collect()}
    found = spark.createDataFrame([(s, b, n) for s, t in TOY.items() for b in range(len(t) - 4) for n in (4, 9, 13) if b + n <= len(t)], "strain long, begin long, length int")
    for r in paths.node_paths(found, graph).collect():
        at, want, dist = 0, [], None
        for omega, kind in plain[r["strain"]]:
            size = len(omega) - (kind == "end")
            if at <= r["begin"] + r["length"] - 4 and at + size - 4 >= r["begin"]:
                want.append(ends[r["strain"]] if kind == "end" else ids[omega, kind])
                dist = r["begin"] - at if dist is None else dist
            at += size - 3
        assert (r["path"], r["dist_left"]) == (want, dist)
    starts = sequences.with_starts(table(spark, TOY)).select("strain", "start", "len")
    asked = spark.createDataFrame([(i,) for i in range(-2, 90)], "position long")
    where = {r["position"]: (r["strain"], r["begin"]) for r in paths.strain_of(asked, starts).collect()}
    text = "".join(f"{TOY[i]}%" for i in TOY)
    for p, (s, b) in where.items():
        assert (s is None) == (not 0 <= p < len(text) or text[p] == "%") and (s is None or TOY[s][b] == text[p])
    words = spark.createDataFrame([("AC",), ("GGA",), ("TTT",), ("",), ("ACGTA",)], "word string")
    nodes = graph.nodes.collect()
    want = {w: sorted(n["node_id"] for n in nodes if w in n["omega"]) for w in ("AC", "GGA", "TTT")}
    assert {r["word"]: r["nodes"] for r in paths.nodes_under_k(words, graph).collect()} == {w: v for w, v in want.items() if v}


@pytest.fixture
def unasked(spark):
    """Nothing is broadcast that the code doesn't ask for, as with large tables."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_few_matches_leave_the_occurrences_unshuffled(spark, unasked):
    graph = Graph(table(spark, TOY), 4)
    found = spark.createDataFrame([(0, 2, 9), (2, 0, 13)], "strain long, begin long, length int")
    met = paths.node_paths(found, graph)
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 2 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_few_nodes_leave_the_edges_unshuffled(spark, unasked, monkeypatch):
    graph = Graph(table(spark, TOY), 4)
    starts = spark.createDataFrame([(0,), (3,)], "node_id long")
    kept = []
    monkeypatch.setattr(subgraph, "cut", lambda df: kept.append(ranking.cut(df)) or kept[-1])
    nodes = subgraph.neighbourhood(starts, graph, 2)
    assert not [x for x in kept if "next" in x.columns]  # the graph's pairs aren't stored
    rows = subgraph.subgraph_edges(nodes, graph, starts)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    # Edges and texts (for either side) are first cut down to the nodes asked for.
    assert rows.count() and plan.count("LeftSemi, BuildRight") >= 4 and "SortMergeJoin [node_id" not in plan


def test_nodes_of_words_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(paths, "PIECE", 3)
    graph = Graph(table(spark, TOY), 4)
    texts = [(n["node_id"], n["omega"]) for n in graph.nodes.collect()]
    words = ["".join(x) for n in (1, 2, 3) for x in product("ACGT", repeat=n)]  # more than one number has bits
    asked = spark.createDataFrame([(w,) for w in [*words, "", "ACGTA", "A"]], "word string")
    want = {w: sorted(i for i, t in texts if w in t) for w in words}
    want = {w: v for w, v in want.items() if v}
    assert {r["word"]: r["nodes"] for r in paths.nodes_under_k(asked, graph).collect()} == want
    assert {r["word"]: r["nodes"] for r in paths.nodes_under_k_text(asked, graph).collect()} == {w: "/".join(map(str, v)) for w, v in want.items()}


def test_subgraph(spark):
    graph = Graph(table(spark, TOY), 4)
    edges = {(r["src"], r["dst"]) for r in graph.edges.collect()}
    starts = spark.createDataFrame([(0,), (3,)], "node_id long")
    seen, front = {0: 0, 3: 0}, {0, 3}
    for hop in (1, 2):
        front = {b for a, b in edges | {(b, a) for a, b in edges} if a in front} - set(seen)
        seen |= dict.fromkeys(front, hop)
    nodes = subgraph.neighbourhood(starts, graph, 2)
    assert {r["node_id"]: r["hops"] for r in nodes.collect()} == seen
    rows = subgraph.subgraph_edges(nodes, graph, starts).collect()
    assert {(r["src"], r["dst"]) for r in rows} == {e for e in edges if set(e) <= set(seen)}
    assert all(r["src_part_of_path"] == (r["src"] in (0, 3)) for r in rows)
    bundled = subgraph.subgraph_edges(nodes, graph, starts, separate=False).collect()
    assert sum(r["multiplicity"] for r in bundled) == sum(r["multiplicity"] for r in rows) and len(bundled) == len({(r["src"], r["dst"]) for r in rows})


@pytest.mark.parametrize(("name", "k"), schemes.supported())
def test_built_in_schemes_are_complete(name, k):
    scheme = schemes.searches(name, k)
    assert schemes.validate(scheme, k) == []
    assert len(list(schemes.patterns(len(scheme[0].order), k))) == len({p for p in product(range(k + 1), repeat=len(scheme[0].order)) if sum(p) <= k})


def test_bad_and_custom_schemes(tmp_path):
    assert schemes.validate([schemes.Search((0, 2, 1), (0, 0, 0), (1, 1, 1))], 1) == ["search 0: connectivity"]
    assert "search 0: decreasing bounds" in schemes.validate([schemes.Search((0, 1), (1, 0), (1, 1))], 1)
    assert any(x.startswith("uncovered") for x in schemes.validate([schemes.Search((0, 1), (0, 0), (0, 1))], 1))
    (tmp_path / "1").mkdir()
    (tmp_path / "name.txt").write_text("own\n")
    (tmp_path / "1" / "searches.txt").write_text("{0,1} {0,0} {0,1}\n{1,0} {0,0} {0,1}\n")
    (tmp_path / "1" / "static_partitioning.txt").write_text("0.4")
    got = schemes.read_scheme(str(tmp_path))
    assert got.name == "own" and len(got.searches[1]) == 2 and got.begins == {1: [0.4]}
    for text in ("1.4", "0.4 0.5", "0"):
        (tmp_path / "1" / "static_partitioning.txt").write_text(text)
        with pytest.raises(ValueError):
            schemes.read_scheme(str(tmp_path))
    with pytest.raises(ValueError):
        schemes.parse_search("{0,1} {0,0}")


def test_exact_walks(spark):
    k = 4
    graph = Graph(table(spark, TOY), k)
    nodes = {r["node_id"]: r["omega"] for r in graph.nodes.collect()}
    mixed = TOY[1][:10] + TOY[1][10:16] + TOY[2][15:22]  # follows edges of two strains
    reads = {(0, 0): TOY[0][2:14], (1, 0): mixed, (2, 0): "AAAACCCC", (3, 0): "ACG"}
    got = {r["read_id"]: r for r in walks.exact_walks(read_table(spark, reads), graph).collect()}
    assert 0 in got and 2 not in got and 3 not in got
    for i, r in got.items():
        text = nodes[r["path"][0]]
        for n in r["path"][1:]:
            text += nodes[n][k - 1 :]
        assert text[r["dist_left"] : r["dist_left"] + r["length"]] == reads[i, 0]


def spelled(strains, k, read, errors):
    """Errors of the best walk from each (path, dist_left) that spells a string within ``errors`` of the read."""
    plain = plain_graph(strains, k)
    step, names = {}, set()
    for segments in plain.values():
        inner = [o for o, kind in segments if kind != "end"]
        names.update(inner)
        for a, b in zip(inner, inner[1:], strict=False):
            step.setdefault(a, set()).add(b)
    out = {}

    def walk(path, text, dist):
        body = text[dist:]
        for n in range(max(len(read) - errors, 1), len(read) + errors + 1):
            # The last k-mer lies in the last node.
            if n <= len(body) and dist + n > len(text) - (len(path[-1]) - (k - 1)) and n >= k:
                ed = distance(body[:n], read)
                if ed <= errors:
                    out[tuple(path), dist] = min(out.get((tuple(path), dist), (9, 9)), (ed, n))
        if len(body) < len(read) + errors:
            for b in step.get(path[-1], ()):
                walk([*path, b], text + b[k - 1 :], dist)

    for a in names:
        for dist in range(len(a) - k + 1):
            walk([a], a, dist)
    return out


def test_edit_walks(spark):
    rng = random.Random(3)
    base = "".join(rng.choices("ACGT", k=60))
    strains = {0: base, 1: base[:30] + "A" + base[31:], 2: base[:20] + base[23:]}
    k = 9
    graph = Graph(table(spark, strains), k)
    omega = {r["node_id"]: r["omega"] for r in graph.nodes.collect()}
    reads = {(0, 0): base[5:40], (1, 0): base[10:28] + "C" + base[29:48], (2, 0): base[12:20] + base[23:30] + "A" + base[31:45]}
    found = walks.edit_walks(read_table(spark, reads), graph, 1)
    got = {}
    for r in found.collect():
        got.setdefault(r["read_id"], {})[tuple(omega[n] for n in r["path"]), r["dist_left"]] = (r["ed"], r["length"])
    assert got == {i: w for (i, _), read in reads.items() if (w := spelled(strains, k, read, 1))}
    same = walks.same_path(found, 1)
    complete, linear = walks.filter_complete(same, graph, 1), walks.filter_linear(same, graph, 1)
    rows = lambda t: {(r["read_id"], tuple(r["path"]), r["dist_left"]) for r in t.collect()}
    assert rows(complete) <= rows(same) and rows(linear) <= rows(same)
    least = {i: min(w.values())[0] for i, w in got.items()}
    for kept in (complete, linear):  # every read keeps a best walk
        assert {r["read_id"]: r["ed"] for r in kept.groupBy("read_id").agg({"ed": "min"}).withColumnRenamed("min(ed)", "ed").collect()} == least


def test_walks_leave_no_copy_of_the_graph(spark, unasked, monkeypatch):
    """What walks go on by is as large as the graph: it is stored in compressed files, which go."""
    graph, kept, gone = Graph(table(spark, TOY), 4), [], []
    monkeypatch.setattr(walks, "cut", lambda df: kept.append(ranking.cut(df)) or kept[-1])
    monkeypatch.setattr(walks, "drop", lambda df: (gone.append(df.columns), ranking.drop(df)), raising=False)
    reads = sequences.both_ways(spark.createDataFrame([(1, "ACGGTTACGATT")], "read_id long, seq string"))
    assert walks.edit_walks(reads, graph, 1).count()
    assert not [x for x in kept if "added" in x.columns] and gone == [["last", "next", "added"]] * 2


def test_walks_among_nodes_alone(spark, monkeypatch):
    """A graph of nodes alone gives the same walks as the whole one: of few reads by looks at its packed texts, of many by its pairs."""
    rng = random.Random(3)
    base = "".join(rng.choices("ACGT", k=60))
    strains = {0: base, 1: base[:30] + "A" + base[31:], 2: base[:20] + base[23:]}
    reads = read_table(spark, {(0, 0): base[5:40], (1, 0): base[10:28] + "C" + base[29:48], (2, 0): base[12:20] + base[23:30] + "A" + base[31:45]})
    whole, few = (Graph(table(spark, strains), 9, nodes_only=n) for n in (False, True))
    rows = lambda t: sorted(map(tuple, t.collect()))
    closed = {r["node_id"] for r in whole.nodes.filter("kind <> 'end'").collect()}
    assert rows(few.pairs) == [x for x in rows(whole.pairs.distinct()) if set(x) <= closed]
    expected, shuffled = rows(walks.edit_walks(reads, whole, 1)), []
    pairs = Graph.pairs
    monkeypatch.setattr(Graph, "pairs", property(lambda g: shuffled.append(g) or pairs.fget(g)))
    assert rows(walks.edit_walks(reads, few, 1)) == expected and not shuffled
    monkeypatch.setattr(walks, "NEAR", 0)
    assert rows(walks.edit_walks(reads, few, 1)) == expected and shuffled == [few, few]


def test_advance():
    """The band's ends are those of the whole table, wherever the text is cut."""
    rng = random.Random(5)
    for _ in range(2000):
        k, pattern, text = rng.randint(0, 4), "".join(rng.choices("AC", k=rng.randint(0, 12))), "".join(rng.choices("AC", k=rng.randint(0, 16)))
        at, start = rng.randint(0, len(text)), [d - k if k <= d <= len(pattern) + k else k + 1 for d in range(2 * k + 1)]
        row, ends = walks.advance(pattern, text[:at], k, start, 0)
        ends += walks.advance(pattern, text[at:], k, row, at)[1]
        assert ends == [(i, e) for i, e in enumerate(walks.prefix_distances(pattern, text)) if i and e <= k]
    assert not walks.hopeless("", "A", 0)


def test_sizes_of_walks_need_no_texts(spark, monkeypatch):
    """The filters of walks take lengths of nodes from the packed texts, which aren't made strings."""
    graph = Graph(table(spark, TOY), 4, nodes_only=True)
    expected = {r["node_id"]: r["len"] for r in graph.nodes.collect()}
    assert {r["node_id"]: r["len"] for r in graph.sizes.collect()} == expected
    monkeypatch.setattr(Graph, "nodes", property(lambda g: 1 / 0))
    path = sorted(expected)[:2]
    found = spark.createDataFrame([(1, 0, path, 0, 6, 0)], walks.FIELDS)
    assert walks.with_sizes(found, graph).first()["sizes"] == [expected[n] for n in path]
    assert walks.filter_complete(found, graph, 1).count() == walks.filter_linear(found, graph, 1).count() == 1


def test_text_index(spark):
    rng = random.Random(6)
    texts = {i: "".join(rng.choices("AC", k=n)) for i, n in enumerate((30, 1, 45, 30))}
    texts[3] = texts[0]
    whole = "%".join(texts.values()) + "$"
    blocks = text_index.text_blocks(table(spark, texts))
    chars = text_index.characters(blocks)
    assert "".join(r["ch"] for r in chars.orderBy("pos").collect()) == whole
    array = text_index.suffix_array(blocks)
    want = sorted(range(len(whole)), key=lambda i: whole[i:])
    assert [r["pos"] for r in array.orderBy("row").collect()] == want
    transform = text_index.bwt(array, chars)
    last = "".join(whole[i - 1] for i in want)
    assert "".join(r["ch"] for r in transform.orderBy("row").collect()) == last
    lf = [r["lf"] for r in text_index.last_to_first(transform).orderBy("row").collect()]
    row, back = 0, []
    for _ in whole:
        back.append(last[row])
        row = lf[row]
    assert "".join(back[::-1])[1:] + "$" == whole


def test_rank_table_positions_and_checks(spark):
    texts = {0: "ACGTACGA", 1: "CCGTA", 2: "ACGTAC"}
    whole = "%".join(texts.values()) + "$"
    blocks = text_index.text_blocks(table(spark, texts))
    chars = text_index.characters(blocks)
    array = text_index.suffix_array(blocks)
    order = sorted(range(len(whole)), key=lambda i: whole[i:])
    transform = text_index.bwt(array, chars)
    last = "".join(whole[i - 1] for i in order)
    want = {(r, c, last[:r].count(c), sum(x < c for x in last[:r])) for r in range(len(last)) for c in "$%ACGT"}
    assert {tuple(r) for r in text_index.rank_table(transform).collect()} == want
    for factor in (1, 4, 8):
        found = text_index.find_positions(array.select("row"), text_index.last_to_first(transform), array.filter(f"pos % {factor} = 0"), factor)
        assert {tuple(r) for r in found.collect()} == set(enumerate(order))
    text_index.check_index(chars, array)
    for bad in ((chars.filter("ch <> '$'"), array), (chars, array.filter("row > 0")), (chars, array.withColumn("pos", array["pos"] + 1)), (chars, array.replace({3: 4}, subset=["pos"]))):
        with pytest.raises(ValueError):
            text_index.check_index(*bad)


def test_text_index_over_blocks(spark, monkeypatch):
    """Texts that end at, before and after the edges of blocks, copies, long runs, empty texts."""
    rng, b = random.Random(7), 64
    monkeypatch.setattr(text_index, "BLOCK", b)
    base = "".join(rng.choices("ACGT", k=2 * b + 5))
    texts = {1: base[: b - 1], 4: "", 5: base[:b], 7: "G" * 150, 8: base, 9: base[3:], 12: "C"}
    whole = "%".join(t for t in texts.values() if t) + "$"
    blocks = text_index.text_blocks(table(spark, texts))
    assert [len(r["chunk"]) for r in blocks.orderBy("block").collect()] == [b] * (len(whole) // b) + [len(whole) % b]
    assert "".join(r["ch"] for r in text_index.characters(blocks).orderBy("pos").collect()) == whole
    want = sorted(range(len(whole)), key=lambda i: whole[i:])
    array = ranking.cut(text_index.suffix_array(blocks))
    assert [r["pos"] for r in array.orderBy("row").collect()] == want
    assert {tuple(r) for r in text_index.grams(blocks, 9).collect()} == {(i, whole[i : i + 9]) for i in range(len(whole))}
    classes = {r["row"]: r["class"] for r in text_index.lcp_classes(array, text_index.grams(blocks, 9), 8).collect()}
    share = lambda i, n: i > 0 and whole[want[i] :][:n] == whole[want[i - 1] :][:n]
    assert classes == {i: 2 if share(i, 9) else 1 if share(i, 8) else 0 for i in range(len(want))}


@pytest.mark.parametrize("sizes", [{"SPAN": 1, "BUCKET": 40, "LOOKED_AT": 8, "ROUNDS": 3}, {"SPAN": 3, "BUCKET": 300}, {}])
def test_packed_index(spark, monkeypatch, sizes):
    """Chunks, ranges and rounds of any size; copies of texts and of rows of texts, runs, repeats and other ends."""
    monkeypatch.setattr(text_index, "BLOCK", 64)
    for name, value in sizes.items():
        monkeypatch.setattr(packed_index, name, value)
    rng = random.Random(8)
    base = "".join(rng.choices("ACGT", k=333))
    texts = dict(enumerate([base, "G" * 150, base, base[5:200] + "T" + base[201:], "AC" * 60, "C", "C", *[base[:70], "ACG"] * 4, "G" * 90]))
    whole = "%".join(texts.values()) + "$"
    want = sorted(range(len(whole)), key=lambda i: whole[i:])
    last = "".join(whole[i - 1] for i in want)
    for factor in (4, 16):
        found = packed_index.Transform(text_index.text_blocks(table(spark, texts)), factor)
        assert sorted(tuple(r) for r in found.positions().collect()) == list(enumerate(want))
    assert "".join(r["ch"] for r in found.rows().orderBy("row").collect()) == last
    ranks = {(r, c, last[:r].count(c), sum(x < c for x in last[:r])) for r in range(len(last)) for c in "$%ACGT"}
    rows = [tuple(r) for r in found.rank_table().collect()]
    assert len(rows) == len(ranks) and set(rows) == ranks


def test_bases_as_bytes(spark):
    letters = "".join(map(chr, range(32, 127)))
    rows = spark.createDataFrame([(1, letters), (2, "é\u212a1"), (3, None), (4, ""), (5, "ſaßK\U0001f600t")], "doc_id long, text string")
    assert sorted(packed_index.bases(rows).collect()) == sorted(sequences.strains_of(rows, 1).collect())


def test_packed_index_of_short_and_no_texts(spark):
    for texts in ({}, {1: ""}, {1: "A"}, {1: "A", 2: "A"}):
        kept = [t for t in texts.values() if t]
        whole = "%".join(kept) + "$" if kept else ""
        rows = spark.createDataFrame([(i, s) for i, s in texts.items()], "strain long, seq string")
        found = packed_index.Transform(text_index.text_blocks(rows), 16)
        want = sorted(range(len(whole)), key=lambda i: whole[i:])
        assert sorted(tuple(r) for r in found.positions().collect()) == list(enumerate(want))
        assert "".join(r["ch"] for r in found.rows().orderBy("row").collect()) == "".join(whole[i - 1] for i in want)


def test_queries_leave_the_rows_of_suffixes(spark, monkeypatch):
    """No row for each suffix is made on the way."""
    from panweave.plans import more_queries

    gone = lambda *a: pytest.fail("a row for each suffix")
    for name in ("suffix_array", "characters", "bwt", "counted_above", "find_positions"):
        monkeypatch.setattr(text_index, name, gone)
    rows = spark.createDataFrame([(1, "ACGTACGA"), (2, "ccg-ta"), (3, None), (4, " 1é")], "doc_id long, text string")
    monkeypatch.setattr(more_queries.T, "table", lambda *a: rows)
    assert [getattr(more_queries, q)(spark, "some").count() for q in ("bwt", "bwt_rank_table", "find_positions")] == [15, 90, 15]


def test_text_index_of_nothing(spark):
    rows = spark.createDataFrame([(1, ""), (2, None)], "strain long, seq string")
    blocks = text_index.text_blocks(rows)
    assert blocks.isEmpty() and text_index.suffix_array(blocks).isEmpty()


def test_prefix_sums_in_three_levels(spark):
    rows = spark.range(500).selectExpr("id", "id % 7 AS a", "-id AS b")
    got = ranking.all_prefix_sums(rows, {"x": F.col("a"), "y": F.col("b")}, "id", bucket=4)
    assert got.columns == ["id", "a", "b", "x", "y"]
    assert [(r["x"], r["y"]) for r in got.orderBy("id").collect()] == [(sum(j % 7 for j in range(i)), -sum(range(i))) for i in range(500)]
