"""Operators on tables: brute force, hard cases, empty tables, clashing names."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from panweave.llm import bpe, common, components, language, licenses, line_dedup, media, packing, quality, queries, simhash, token_counts, toxicity

WORDS, BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SF = "/root/testdata/sf0.001"
HARD = [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "same text here " * 30), (6, "same text here " * 30), (6, "same text here " * 30), (None, "no id at all"), (None, None), (7, "x" * 20000), (8, "word " * 9000)]


def docs(spark, rows=HARD):
    return spark.createDataFrame(rows, "doc_id long, text string")


def labels(spark, rows=((1, 0, 0), (4, 1, 1), (5, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


PER_DOCUMENT = {
    "quality": lambda d, s: quality.score_quality(d), "licenses": lambda d, s: licenses.scan_licenses(d), "media": lambda d, s: media.media_digests(d),
    "bpe": lambda d, s: bpe.token_digests(d, BPE, public_tokenizers.PATTERN), "simhash": lambda d, s: simhash.simhash_components(d),
    "toxicity": lambda d, s: toxicity.score_toxicity(d, labels(s)), "lines": lambda d, s: line_dedup.line_report(d), "tokens": lambda d, s: token_counts.count_document_tokens(d, WORDS),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_hard_rows_and_empty_tables(spark, name):
    operator = PER_DOCUMENT[name]
    rows = operator(docs(spark), spark).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)) == sorted((i is None, i or 0) for i, _ in HARD)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r["doc_id"]].add(str([v for k, v in r.asDict().items() if k not in ("file", "ordinal", "start")]))
    assert len(by_id[6]) == 1  # repeated rows, equal results
    assert operator(docs(spark, []), spark).collect() == []


STAGES = {"toxicity": lambda d, s: toxicity.drop_toxic(d, labels(s)), "quality": lambda d, s: quality.keep_good(d), "lines": lambda d, s: line_dedup.dedup_lines(d), "near": lambda d, s: simhash.drop_near_duplicates(d)}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_of_any_name(spark, name):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text + ".", 1, 2.0, "a", "b", 5), (2, None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score int, kept double, node string, line_dedup_gone string, `near_duplicate_node` int")
    out = STAGES[name](table, spark)
    assert out.columns == table.columns and out.dtypes == table.dtypes
    assert (1, text + ".", 1, 2.0, "a", "b", 5) in [tuple(r) for r in out.collect()]
    assert STAGES[name](table.limit(0), spark).collect() == []


def test_quality_keeps_clean_and_drops_junk(spark):
    rng = random.Random(1)
    clean = [(i, "\n".join(" ".join(f"word{rng.randrange(500)}" for _ in range(12)).replace("0", "o").replace("1", "i") + "." for _ in range(8))) for i in range(60)]
    junk = [(100 + i, " ".join(f"bad{rng.randrange(900)}###" for _ in range(90))) for i in range(12)]
    kept = {r["doc_id"] for r in quality.score_quality(docs(spark, clean + junk)).filter("kept").collect()}
    assert not kept & {i for i, _ in junk}
    assert {r["doc_id"] for r in quality.keep_good(docs(spark, clean + junk)).collect()} == kept


def clusters(fps):
    fps = np.array(fps, np.int64)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count((fps[i] ^ fps[:i]).view(np.uint64)) <= 4):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_number_of_blocks():
    chosen = [simhash.blocks_for(10**i) for i in range(16)]
    assert chosen == sorted(chosen) and chosen[0] == 5 and chosen[-1] == simhash.MOST_BLOCKS
    assert all(n / 2 ** (64 * (b - 4) // b) <= simhash.BY_CHANCE for n, b in ((10**i, chosen[i]) for i in range(12)))


@pytest.mark.parametrize(("crowd", "blocks"), [(512, None), (512, 7), (5, 6), (5, None)])
def test_fingerprint_links(spark, crowd, blocks):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(500):
        x = rng.choice(fps[-150:])
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in fps})
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd=crowd, blocks=blocks)
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert [roots.get(x, x) for x in fps] == [fps[i] for i in clusters(fps)]


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark):
    rows = queries.op9_simhash(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in common.documents(spark, SF).collect()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{plain_fingerprint(t, 4):016x}" for i, t in texts.items()}
    ids = sorted(texts)
    fps = [np.int64(np.uint64(plain_fingerprint(texts[i], 4)).view(np.int64)) for i in ids]
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: ids[c] for i, c in zip(ids, clusters(fps), strict=True)}


@pytest.mark.parametrize("batch", [1 << 20, 7])
def test_components(spark, monkeypatch, batch):
    monkeypatch.setattr(components, "ROUND", batch)
    rng = random.Random(batch)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 1)] + [(1000, 1000 + i) for i in range(1, 60)] + [(3000, 2000 + i) for i in range(60)]
    links += [(-x, -y) for x, y in ((rng.randrange(1, 90), rng.randrange(1, 90)) for _ in range(60))]
    root = {x: x for pair in links for x in pair}
    for _ in links:  # plain: labels go along links until all are equal
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    want = {x: r for x, r in root.items() if x is not None and any(x in pair and pair[0] != pair[1] and None not in pair for pair in links)}
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def jaccard_kept(texts, size=5, least=0.8):
    sets = {i: set(simhash.shingle_hashes(t, size).tolist()) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            total = len(sets[i] | sets[j])
            if not total or len(sets[i] & sets[j]) >= least * total:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def test_near_duplicates(spark):
    rng = random.Random(9)
    texts = {i: " ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 60, 200]))) for i in range(150)}
    for i in range(150, 300):
        words = texts[rng.randrange(150 if i % 2 else 5)].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"new{i}"
        texts[i] = " ".join(words)
    texts |= {300: "", 301: "  "}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert kept == jaccard_kept(texts)


def test_near_duplicates_that_share_a_passage(spark):
    """Pairs of similarity 0.82 in texts that are all similar by 0.77, so that no chain of others links them."""
    passage = " ".join(f"p{i}" for i in range(349))
    texts = {i: f"{passage} " + " ".join(f"q{i // 2}x{j}" for j in range(13)) + " " + " ".join(f"o{i}x{j}" for j in range(38)) for i in range(200)}
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert kept == jaccard_kept(texts) == set(range(0, 200, 2))


@pytest.mark.parametrize(("few", "chunk"), [(64, 1 << 20), (3, 50), (1, 1)])
def test_pairs_of_groups(monkeypatch, few, chunk):
    monkeypatch.setattr(simhash, "FEW", few)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(7)
    rows = sorted((g, rng.randrange(20, 40), 100 * g + i, rng.choice([1, 1, 1, 2, 3, 50 + i]), rng.randrange(18, 45)) for g in range(30) for i in range(rng.choice([1, 2, 3, 9, 30])))
    near = lambda x, y: min(x[1], y[1]) >= 0.8 * max(x[1], y[1]) and x[1] <= y[4] and y[1] <= x[4]
    want = {(max(x[2], y[2]), min(x[2], y[2])) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and x[3] != y[3] and near(x, y)}
    got = [tuple(x) for pairs in simhash.pairs_of_groups(np.array(rows, np.int64).T, 0.8) for x in pairs.T.tolist()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_within_a_group_of_fingerprints(spark, monkeypatch):
    """Without bands: similar texts of close fingerprints whose group is linked through texts that aren't similar to them."""
    monkeypatch.setattr(simhash, "band_members", lambda signed: signed.select(*(F.lit(0).cast("long").alias(c) for c in ("band", "node", "first", "before"))).limit(0))
    heavy = " ".join(f"h{i}" for i in range(12))
    texts = {}
    for i in range(40):  # a passage often repeated makes the fingerprint; the words around it, the set
        texts[i] = f"{heavy} " * 60 + " ".join(f"g{i // 2}x{j}" for j in range(40)) + (f" end{i}" if i % 2 else "")
    made = [np.int64(np.uint64(plain_fingerprint(t, 5)).view(np.int64)) for t in texts.values()]
    assert len(set(clusters(made))) == 1  # one group by fingerprints
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert kept == jaccard_kept(texts) == set(range(0, 40, 2))


def test_near_duplicates_of_rows_that_share_an_id(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (3, text("c")), (3, text("d")), (3, text("d") + " more"), (4, text("c")), (5, text("a")), (6, text("e"))]
    out = [tuple(r) for r in simhash.drop_near_duplicates(docs(spark, rows)).collect()]
    assert len(out) == 5 and {(i, t.removesuffix(" more")) for i, t in out} == {(None, text("a")), (None, text("b")), (3, text("c")), (3, text("d")), (6, text("e"))}


def test_near_duplicates_whose_fingerprints_are_far_apart(spark):
    """Nearly equal sets, but one text repeats a passage so often that the fingerprints differ in over 26 bits."""
    texts, far = {}, 0
    for i in range(40):
        words = [f"w{i}x{j}" for j in range(200)]
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(words + words[:24] * 60)}
        far += (plain_fingerprint(texts[2 * i], 5) ^ plain_fingerprint(texts[2 * i + 1], 5)).bit_count() > 26
    assert far
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs(spark, list(texts.items()))).collect()}
    assert kept == jaccard_kept(texts) == set(range(0, 80, 2))


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i + 100, " ".join(rng.choices("the and of river stone Blue".split(), k=rng.choice([0, 3, 60, 900, 6000])))) for i in range(40)] + HARD
    out = packing.pack(docs(spark, rows), WORDS, group=15).toPandas()
    assert out["length"].gt(0).all()
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].values == np.concatenate([[0], s["length"].cumsum().values[:-1]])).all() and s["length"].sum() <= packing.CAPACITY
    for doc, s in out[(out.doc_id < 5) | (out.doc_id >= 100)].groupby("doc_id"):
        s = s.sort_values("start")
        assert s["length"].sum() == s["doc_tokens"].iloc[0] and (s["start"].values == np.concatenate([[0], s["length"].cumsum().values[:-1]])).all(), doc
    assert len(out[out.doc_id == 6]) >= 2 and out[out.doc_id == 1]["length"].tolist()[0] == 1
    assert packing.pack(docs(spark, []), WORDS).collect() == []


def test_packing_of_rows_that_share_an_id(spark):
    rows = [(None, "the same text")] * 3000 + [(7, "the same text")] * 500
    out = packing.pack(docs(spark, rows), WORDS, group=100).toPandas()
    sizes = (out["sequence_id"] // 2**32).value_counts()
    assert len(out) == 3500 and len(sizes) == 35 and sizes.max() < 200
    for _, s in out.groupby("sequence_id"):
        assert sorted(s["offset"]) == [i * int(s["length"].iloc[0]) for i in range(len(s))]


def test_first_fit():
    rng = random.Random(4)
    lengths = sorted((rng.randint(1, 100) for _ in range(400)), reverse=True)
    rooms, want = [], []
    for n in lengths:
        place = next((i for i, r in enumerate(rooms) if r >= n), len(rooms))
        if place == len(rooms):
            rooms.append(100)
        want.append((place, 100 - rooms[place]))
        rooms[place] -= n
    assert packing.first_fit_decreasing(lengths, 100) == want


def test_token_counts(spark):
    counted = {r["doc_id"]: r["n_tokens"] for r in queries.op4_token_counts(spark, SF).collect()}
    packed = {r["doc_id"]: r["doc_tokens"] - 1 for r in queries.op7_packing(spark, SF).collect()}
    assert counted == packed


@pytest.mark.parametrize("block", [1, 3, 8])
def test_separator_scan(spark, block):
    rng = random.Random(block)
    files = {f: [rng.choice([0, 0, 5, 6, 7]) for _ in range(rng.randrange(1, 60))] for f in range(6)}
    files[9] = [5] * 50
    rows = [(f, i // block, bytearray(np.array(t[i : i + block], "<u2").tobytes())) for f, t in files.items() for i in range(0, len(t), block)]
    table = spark.createDataFrame(rows, "file long, block long, data binary")
    want = set()
    for f, t in files.items():
        start = ordinal = 0
        for i, x in enumerate(t):
            if x == 0:
                want.add((f, ordinal, start, i - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < len(t):
            want.add((f, ordinal, start, len(t) - start, False))
    assert {tuple(r) for r in token_counts.count_tokens(table, separator=0, block=block).collect()} == want


def test_raw_token_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = set()
    for name, n in (("a", 1), ("b", 5000), ("c", 0), ("d", 4096)):
        ids = rng.integers(0, 9, n).astype("<u2")
        ids.tofile(tmp_path / name)
        ends = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], ends + 1])
        want |= {(i, int(a), int(b - a), True) for i, (a, b) in enumerate(zip(starts, ends, strict=False))}
        want |= {(len(ends), int(starts[-1]), int(n - starts[-1]), False)} if starts[-1] < n else set()
    blocks = token_counts.read_flat_files(spark, str(tmp_path), block=64)
    found = token_counts.count_tokens(blocks, separator=0, block=64).collect()
    assert {tuple(r)[1:] for r in found} == want and len({r["file"] for r in found}) == 3
    (tmp_path / "e").write_bytes(b"abc")
    with pytest.raises(Exception, match="ends within an id"):
        token_counts.read_flat_files(spark, str(tmp_path), block=64).collect()
    with pytest.raises(ValueError, match="doesn't fit"):
        token_counts.narrowed(np.array([1, 70000], "<u4"), 2, 0)


def test_media_column(spark):
    table = media.store_media(docs(spark))
    read = media.read_media(table).collect()
    texts = sorted((t or "").encode() for _, t in HARD)
    assert sorted(r["payload"].rstrip(b" ") for r in read) == sorted(t.rstrip(b" ") for t in texts)
    assert all(r["timestamps"] == [i * media.PTS_STEP for i in range(len(r["timestamps"]))] and r["continuity_errors"] == 0 for r in read)
    none = media.read_media(spark.createDataFrame([(1, None)], "doc_id long, media binary")).first()
    assert none["payload"] is None and none["timestamps"] is None


def test_line_alignment():
    assert line_dedup.longest_chain([3, 1, 2, 5, 4, 6]) in ([1, 2, 3, 5], [1, 2, 4, 5])
    assert line_dedup.longest_chain([]) == []


def plain_patience(here, there):
    """Patience diff of two lists of lines by the book."""
    if not here or not there:
        return []
    once = [x for x in here if here.count(x) == 1 and there.count(x) == 1]
    if not once:
        return None
    places, best = [there.index(x) for x in once], []
    chains = [[] for _ in once]
    for i, p in enumerate(places):
        chains[i] = max((chains[j] for j in range(i) if places[j] < p), key=len, default=[]) + [i]
        best = max(best, chains[i], key=len)
    return [(here.index(once[i]), places[i]) for i in best]


def test_patience_diff():
    rng = random.Random(6)
    for _ in range(300):
        here, there = ([rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = [(i, j, here.count(x) == 1 and there.count(x) == 1) for i, x in enumerate(here) for j, y in enumerate(there) if x == y]
        got = line_dedup.patience(pairs)
        assert all(here[i] == there[j] for i, j in got) and got == sorted(got) and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:], strict=False))
        anchors = plain_patience(here, there) or []
        assert len([x for x in got if (*x, True) in pairs]) >= len(anchors)  # recursion may find more
        # Between anchors nothing that could be matched is left.
        ends = [(-1, -1), *got, (99, 99)]
        assert not any(a < i < c and b < j < d for (a, b), (c, d) in zip(ends, ends[1:], strict=False) for i, j, _ in pairs)
    assert line_dedup.patience([(0, 0, True), (1, 5, True), (2, 1, True), (3, 2, True), (4, 4, False)]) == [(0, 0), (2, 1), (3, 2), (4, 4)]
    assert line_dedup.blocks_of([(0, 0), (1, 1), (2, 5), (3, 6), (5, 7)]) == [[(0, 0), (1, 1)], [(2, 5), (3, 6)], [(5, 7)]]


def test_alignment_of_blocks():
    line = lambda place, there, words=10, owner=1, rare=True: (place, words, owner, 9, there, 0, 0, rare)
    shared = [line(0, 7), line(1, 8), line(3, 2), line(4, 3, 4), line(6, 0, 30, 2), line(8, 5, 30, 3, False)]
    assert line_dedup.align(shared) == ({0, 1, 6}, {1, 2})  # the first two are moved; the last line is frequent
    assert line_dedup.to_delete([*shared, (8, 30, 3, 9, 5, 1, 1, False)]) == ([0, 1, 6, 8], [1, 2, 3])


def test_line_dedup(spark):
    line = lambda tag: " ".join(f"{tag}{i}" for i in range(14))
    block = "\n".join(line(f"b{i}") for i in range(4))
    rows = [(1, f"{line('p')}\n{block}\n{line('q')}"), (2, f"{line('r')}\n\n{block}\n{line('s')}"), (3, f"{line('t')}\nshort line\n{line('u')}"), (4, "short line"), (5, block), (5, block), (None, line("b0") + "\n" + line("b1"))]
    out = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    first = (None, line("b0") + "\n" + line("b1"))
    assert out == {first, (1, f"{line('p')}\n{line('b2')}\n{line('b3')}\n{line('q')}"), (2, f"{line('r')}\n\n{line('s')}"), rows[2], rows[3], (5, "")}


def plain_gone(texts, least=20):
    """Places of each text's lines that lie in a run of lines, of so many words, which an earlier text has."""
    kept = {i: [x.strip() for x in t.split("\n") if x.strip()] for i, t in texts.items()}
    runs = lambda x: {(a, b): tuple(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(len(y.split()) for y in x[a:b]) >= least}
    earlier, gone = set(), {}
    for i in sorted(kept):
        found = runs(kept[i])
        gone[i] = sorted({p for (a, b), x in found.items() if x in earlier for p in range(a, b)})
        earlier |= set(found.values())
    return gone


def test_line_dedup_of_blocks_whose_lines_have_other_owners(spark):
    """A block's lines all occur earlier, each in another document, so no two of them have one earliest holder."""
    line = lambda tag: " ".join(f"{tag}{i}" for i in range(9))
    texts = {i: f"{line(f'own{i}x')}\n{line(f'b{i}x')}" for i in range(5)}
    block = "\n".join(line(f"b{i}x") for i in range(5))
    texts |= {5: f"{line('p')}\n{block}", 6: f"{line('q')}\n{block}\n{line('r')}", 7: block}
    rows = {r["doc_id"]: r for r in line_dedup.line_report(docs(spark, list(texts.items()))).collect()}
    assert {i: r["removed"] for i, r in rows.items()} == plain_gone(texts)
    assert rows[5]["removed"] == [] and rows[6]["removed"] == [1, 2, 3, 4, 5] and rows[6]["sources"] == [5] and rows[7]["n_chars_left"] == 0


def test_line_dedup_of_short_lines(spark):
    rng = random.Random(3)
    verse = "\n".join(" ".join(f"v{i}x{j}" for j in range(6)) for i in range(10))
    texts = {1: verse, 2: f"Another first line\n{verse}\nand a last one", 3: verse}
    texts |= {i: "\n".join(" ".join(rng.choices("ab", k=rng.choice([1, 2, 5, 7, 15, 25]))) if rng.random() < 0.3 else f"w{rng.randrange(4)} x y" for _ in range(30)) for i in range(4, 24)}
    rows = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs(spark, list(texts.items()))).collect()}
    want = plain_gone(texts)
    assert rows[1] == [] and rows[2] == list(range(1, 11)) and rows[3] == list(range(10))
    assert rows == want


def test_line_dedup_of_moved_and_repeated_passages(spark):
    line = lambda tag, n=12: " ".join(f"{tag}{i}" for i in range(n))
    x, y, other = line("x"), line("y"), line("o")
    texts = {1: f"{x}\n{y}", 2: f"{x}\n{other}\n{x}\n{y}", 3: f"{line('z')}\n{y}\n{x}", 4: f"{x}\n{other}\n{x}\n{y}\n{x}\n{other}\n{line('q', 30)}", 5: f"{line('q', 30)}\n{y}\n{x}"}
    rows = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs(spark, list(texts.items()))).collect()}
    assert rows == plain_gone(texts) and rows[2] == [2, 3] and rows[3] == [] and rows[5] == [0, 1, 2]


def test_line_dedup_query(spark):
    """The whole query against a plain search for repeated runs."""
    texts = {r["doc_id"]: r["text"] or "" for r in common.documents(spark, SF).collect()}
    own = {i: t for i, t in texts.items() if t.count("\n") < 60}
    rows = {r["doc_id"]: r["removed"] for r in line_dedup.line_report(docs(spark, list(own.items()))).collect()}
    assert rows == plain_gone(own) and any(rows.values())


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op10_toxicity(spark, "/root/testdata/sf0.1").join(common.table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    assert all(0 <= r["score"] <= 1 for r in rows)
    toxic = [r["predicted"] for r in rows if r["toxic"] > 0]
    clean = [r["predicted"] for r in rows if not r["toxic"]]
    assert len(toxic) > 50 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_families_of_words(spark):
    """Insults that share a stem, each too rare to be learned by itself; and a repeated id whose texts differ."""
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(1200):
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(50)]
        if toxic := i % 6 == 0:
            words[rng.randrange(50)] = f"schnor{''.join(rng.choices('aeioutk', k=5))}"
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    rows.append((3, "schnoraaaaa " * 3))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert "schnor" in model.stems and all(x.startswith("schnor") for x in [*model.stems, *model.insults])
    assert model.scores(["a new schnorxyz here", "schn or bala"]).round().tolist() == [1, 0]


def test_language(spark):
    found = queries.op8_language_id(spark, SF)
    assert found.count() == common.table(spark, SF, "pages").count()
    pages = spark.createDataFrame([(1, None, None), (2, "http://[bad", ""), (3, "https://a.de/x", "<html lang=fr>"), (4, "https://b.org/", "<p>und nicht die heit ein der</p><script>the and of</script>")], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in language.identify(pages, common.table(spark, SF, "documents")).collect()}
    assert len(rows) == 4 and rows[4]["text_lang"] == "de" and rows[3]["declared"] == "fr" and rows[3]["named"] == "de"
    assert language.identify(pages.limit(0), common.table(spark, SF, "documents")).collect() == []
    none = language.identify(pages, common.table(spark, SF, "documents").limit(0)).collect()
    assert len(none) == 4 and all(r["lang"] is None for r in none)


def test_language_fusion_against_a_plain_version(spark):
    """The fusion written out page by page, from the same evidence."""
    docs_, pages = common.table(spark, SF, "documents"), common.table(spark, SF, "pages")
    pages = pages.unionByName(pages.limit(3)).unionByName(spark.createDataFrame([(900, None, None), (901, "https://x.co.uk/", "<html lang=zz>"), (902, "https://y.co.uk/", "")], "page_id long, url string, html string")).withColumn("P", F.lit(1))
    model = language.learn(docs_)
    names, n = model.languages, len(model.languages)
    rows = [r.asDict() for r in language.evidence(pages, model).collect()]
    total = np.sum([r["p"] for r in rows], 0)
    everywhere = (total + 1) / (len(rows) + n)
    hosts, domains = defaultdict(list), defaultdict(list)
    for r in rows:
        hosts[r["domain"], r["host"]].append(r["p"])
        domains[r["domain"]].append(r["p"])

    def trust(column, value, i):
        values = [*names, language.OTHER]
        counts = {v: sum(r["p"][i] for r in rows if r[column] == v) + language.TRUST * (0.9 if v == names[i] else 0.1 / n) for v in values}
        return 1.0 if value is None else counts[value] / sum(counts.values())

    want = defaultdict(list)
    for r in rows:
        p = np.array(r["p"])
        d, h = np.array(domains[r["domain"]]), np.array(hosts[r["domain"], r["host"]])
        of_domain = (d.sum(0) - p + language.LEAN * everywhere) / (len(d) - 1 + language.LEAN)
        of_host = (h.sum(0) - p + language.LEAN * of_domain) / (len(h) - 1 + language.LEAN)
        joint = np.maximum(of_host, 1e-9) * np.maximum(p, 1e-12) * [trust("declared", r["declared"], i) * trust("named", r["named"], i) for i in range(n)]
        want[r["page_id"]].append((names[int(joint.argmax())], joint.max() / joint.sum()))
    got = defaultdict(list)
    for r in language.identify(pages, docs_).collect():
        got[r["page_id"]].append((r["lang"], r["confidence"]))
    assert got.keys() == want.keys() and sum(map(len, got.values())) == len(rows)
    for i, found in got.items():
        assert [x for x, _ in sorted(found)] == [x for x, _ in sorted(want[i])] and [c for _, c in sorted(found)] == pytest.approx([c for _, c in sorted(want[i])])


def test_rare_languages_are_learned(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    rows = [(i, "aa", " ".join(word("abcde") for _ in range(30))) for i in range(1500)] + [(9000 + i, "bb", " ".join(word("vwxyz") for _ in range(30))) for i in range(2)]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.languages == ["aa", "bb"] and model.posterior("vwxyz zyxwv").argmax() == 1
    many = [(i % 9000, "aa", f"w{chr(97 + i % 26)}") for i in range(12000)]
    sizes = language.learn(spark.createDataFrame(many + [(1, None, "x"), (None, "cc", "yyy")], "doc_id long, lang string, text string"))
    assert sizes.languages == ["aa"]


def test_language_of_documents(spark):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = language.learn(table)
    rows = table.select("lang", "text").collect()
    right = sum(model.languages[int(np.argmax(model.posterior(r["text"])))] == r["lang"] for r in rows)
    assert right / len(rows) > 0.98


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "line_dedup", "simhash_near_dedup", "packing"]
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    common.table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    common.table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_of_single_texts(spark):
    """op1, op2, op3, op6 and op7 over whole tables against plain versions and the tokenizer libraries."""
    import hashlib
    import zlib

    import tiktoken
    from tests.llm.test_texts import plain_features, plain_license_words
    from tokenizers import Tokenizer

    texts = {r["doc_id"]: r["text"] or "" for r in common.documents(spark, SF).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()

    rows = {r["doc_id"]: r for r in queries.op1_quality_rules(spark, SF).collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_features_fast(texts[i], plain_features)
        assert not (r["base_failed"] and r["kept"])

    for r in queries.op2_license_scans(spark, SF).collect():
        words = plain_license_words(texts[r["doc_id"]])
        found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p := phrase.split())] == p]
        places = [i for i, _ in found]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(found), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1

    for r in queries.op3_media_columns(spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), sha(padded), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(m := media.mux(padded)), sha(m))

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.encoder(BPE, public_tokenizers.PATTERN).ranks, special_tokens={})
    for r in queries.op6_byte_bpe(spark, SF).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r["doc_id"]].encode()))

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    pieces = defaultdict(list)
    for r in queries.op7_packing(spark, SF).collect():
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids = [*tokenizer.encode(texts[i], add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def plain_features_fast(text, plain):
    """The plain version looks at all pairs of windows; long texts count them first."""
    if len(text) < 4000:
        return plain(text)
    import re
    from collections import Counter

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_learning_ignores_copies(spark):
    """Words of a toxic document that is there many times aren't insults; words that many toxic documents share are."""
    rng = random.Random(11)
    text = lambda words, n=60: " ".join(rng.choice(words) for _ in range(n))
    common_words = [f"word{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 8 == 0
        rows.append((i, text(common_words) + (f" {rng.choice(common_words)} clown." if toxic else "")))
        marks.append((i, 1, int(toxic)))
    copied = text([f"rare{i}" for i in range(300)], 80)
    for i in range(900, 1000):
        words = copied.split()
        words[rng.randrange(80)] = "changed"
        rows.append((i, " ".join(words)))
        marks.append((i, 1, 1))
    model = toxicity.learn(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert set(model.insults) == {"clown"} and np.isfinite(model.weights).all()
    assert model.scores(["you clown. a clown.", "word1 word2", None]).round().tolist() == [1, 0, 0]


def test_logistic_settles():
    rng = np.random.default_rng(1)
    y = np.repeat([0.0, 1.0], [9000, 1000])
    x = np.column_stack([y * 3 + rng.random(10000) * 0.01, np.zeros(10000), y, y * 2])
    w = toxicity.logistic(x, y)
    assert np.isfinite(w).all() and (w[1:] >= 0).all() and ((w[0] + x @ w[1:] > 0) == (y > 0)).all()


def test_line_dedup_of_many_rows(spark):
    """More rows than are turned into objects at a time."""
    block = "\n".join(" ".join(f"b{j}é{i}" for j in range(14)) for i in range(3))
    own = lambda i: f"Own líne {i} " + "x" * (i % 40)
    rows = [(i, f"{own(i)}\n{block}" if i % 3 else own(i)) for i in range(2500)]
    out = line_dedup.dedup_lines(docs(spark, rows).coalesce(1)).collect()
    assert {tuple(r) for r in out} == {(i, f"{own(i)}\n{block}" if i == 1 else own(i)) for i in range(2500)}


def test_tokens_of_many_rows(spark):
    """Batches of more rows than are encoded together."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    rows = [(i, " ".join(rng.choices(["Über", "the", "cat's", "naïve,", "x|y", "3.14", "漢字"], k=rng.randrange(6)))) for i in range(12000)]
    plain = Tokenizer.from_file(WORDS)
    out = packing.pack(docs(spark, rows).coalesce(1), WORDS).collect()
    import zlib

    want = {(i, zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in rows}
    assert {(r["doc_id"], r["ids_crc32"]) for r in out} == want
