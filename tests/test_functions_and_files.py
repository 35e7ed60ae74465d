"""Column functions, files, streams and the driver's contract."""

import importlib.util
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from panweave.functions import dna as D
from panweave.operators import sequences
from panweave.operators.graph import Graph
from panweave.operators.ranking import numbered
from panweave.plans import catalog
from panweave.sources import files
from panweave.streaming import reads as streams


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


def test_functions(spark):
    s = F.col("s")
    assert one(spark, D.dna(s), s="Ab, z! é") == "ACC"
    assert one(spark, D.revcomp(s), s="AACG") == "CGTT" and one(spark, D.revcomp(s), s="") == ""
    assert one(spark, D.kmer_code(s), s="ACGT") == 0b00011011
    assert one(spark, D.canonical(s), s="TTT") == "AAA"
    assert one(spark, D.iupac_clean(s), s="acgtRN") == "ACGTAC"[:4] + "AG"[4 % 2] + "ACGT"[5 % 4]
    assert one(spark, D.iupac_clean(s), s="ACX") is None
    assert one(spark, D.short_label(s), s="A" * 15) == "A" * 15
    assert one(spark, D.short_label(s), s="AAAAACCCCCCGGGGG") == "AAAAA..(+6)..GGGGG"
    assert one(spark, D.hamming(F.col("a"), F.col("b")), a="ACGT", b="AGGA") == 2


def test_kmer_codes(spark):
    k = 7
    rows = spark.createDataFrame([(x,) for x in ("AAAAAAA", "ACGTACG", "TTTTTTT", "GATTACA")], "kmer string")
    code = D.kmer_code(F.col("kmer"))
    columns = [D.kmer_text(code, k).alias("same"), *(D.peek(code, i, k).alias(f"p{i}") for i in range(k)), D.kmer_text(D.push_right(code, F.lit("C"), k), k).alias("right"), D.kmer_text(D.push_left(code, F.lit("G"), k), k).alias("left")]
    for r in rows.select("kmer", *columns).collect():
        x = r["kmer"]
        assert r["same"] == x == "".join(r[f"p{i}"] for i in range(k)) and r["right"] == x[1:] + "C" and r["left"] == "G" + x[:-1]


def test_numbered(spark):
    rng = random.Random(1)
    values = rng.sample(range(10**6), 500)
    got = numbered(spark.createDataFrame([(v,) for v in values], "v long"), "n", "v").collect()
    assert {r["v"]: r["n"] for r in got} == {v: i for i, v in enumerate(sorted(values))}


def test_reads(spark):
    rows = spark.createDataFrame([(1, "a" * 250), (2, "acgt"), (3, ""), (4, "b" * 100)], "item_id long, text string")
    got = {r["read_id"]: r["seq"] for r in sequences.reads_of(rows, 100).collect()}
    assert {k: len(v) for k, v in got.items()} == {1_000_000: 100, 1_000_001: 150, 2_000_000: 4, 4_000_000: 100}
    changed = {r["read_id"]: r["seq"] for r in sequences.mutated(sequences.reads_of(rows, 100)).collect()}
    assert all(sum(a != b for a, b in zip(got[i], changed[i], strict=True)) == 1 for i in got)


def test_genome_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nACGT\nNNAC\n>two\nGG\n")
    (tmp_path / "b.fa").write_text(">three\r\nacgt\r\n")
    whole = files.fasta_strains(spark, str(tmp_path)).orderBy("strain").collect()
    assert [r["seq"] for r in whole] == ["ACGT" + "ACGT"[4 % 4] + "ACGT"[5 % 4] + "ACGG", "ACGT"]
    parts = files.fasta_contigs(spark, str(tmp_path)).orderBy("strain").collect()
    assert [(r["name"], r["seq"]) for r in parts] == [("one x", "ACGTACAC"), ("two", "GG"), ("three", "ACGT")]
    (tmp_path / "t.txt").write_text("ACG%TT%A$\n")
    text = files.preprocessed_text(spark, str(tmp_path / "t.txt"))
    assert [(r["strain"], r["seq"]) for r in text.collect()] == [(0, "ACG"), (1, "TT"), (2, "A")]
    files.check_strains(text)
    with pytest.raises(ValueError):
        files.check_strains(text.limit(1))
    with pytest.raises(ValueError):
        files.check_strains(text.unionByName(spark.createDataFrame([(9, "AXC")], "strain long, seq string")))


def test_read_files(spark, tmp_path):
    (tmp_path / "r.fa").write_text(">r1 a A->G\nACG\nTT\n>r2\r\nANC\r\n>r3\nGG\n")
    got = files.read_reads(spark, str(tmp_path / "r.fa"))
    assert sorted(map(tuple, got.collect())) == [("r1 a A->G", "ACGTT"), ("r2", "ANC"), ("r3", "GG")]
    assert sorted(r["read_id"] for r in sequences.without_n(got).collect()) == ["r1 a A->G", "r3"]
    (tmp_path / "r.fq").write_text("@r1\nACG\n+\n@@@\n@r2\nTTT\n+\nIII\n")
    assert list(map(tuple, files.read_reads(spark, str(tmp_path / "r.fq")).collect())) == [("r1", "ACG"), ("r2", "TTT")]
    (tmp_path / "r.csv").write_text("n,position,read\n0,17,acg\n")
    assert list(map(tuple, files.read_reads(spark, str(tmp_path / "r.csv")).collect())) == [("17", "ACG")]
    with pytest.raises(ValueError):
        files.read_reads(spark, str(tmp_path / "r.bam"))


def test_files_in_many_splits(spark, tmp_path):
    """Records and lines that the reader's splits cut anywhere."""
    import random

    rng = random.Random(3)
    seq = lambda n: "".join(rng.choices("ACGT", k=n))
    reads = {f"r{i} @x": seq(rng.randrange(1, 90)) for i in range(300)}
    (tmp_path / "a.fq").write_text("".join(f"@{i}\n{s}\n+\n{'@' * len(s)}\n" for i, s in reads.items()))
    contigs = [(f"c{i} 5'->3'", seq(rng.randrange(1, 200)), rng.choice([10, 70])) for i in range(60)]
    (tmp_path / "b.fa").write_text("".join(f">{h}\n" + "".join(s[i : i + n] + "\n" for i in range(0, len(s), n)) for h, s, n in contigs))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700", "1111", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert {r["read_id"]: r["seq"] for r in files.fastq_reads(spark, str(tmp_path / "a.fq")).collect()} == reads
            assert sorted(map(tuple, files.fasta_contigs(spark, str(tmp_path / "b.fa")).select("name", "seq").collect())) == sorted((h, s) for h, s, _ in contigs)
            assert [r["seq"] for r in files.fasta_strains(spark, str(tmp_path / "b.fa")).collect()] == ["".join(s for _, s, _ in contigs)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_edge_file(spark, tmp_path):
    names = "edge_key string, src long, src_omega_short string, src_omega_full string, src_part_of_path boolean, dst long, dst_omega_short string, dst_omega_full string, dst_part_of_path boolean, color string, multiplicity long"
    files.write_edges(spark.createDataFrame([("Edge0", 1, "A", "A", True, 2, "C", "C", False, "0", 3)], names).coalesce(1), str(tmp_path / "e"))
    (part,) = (tmp_path / "e").glob("part-*")
    assert part.read_text() == "\t".join(files.EDGE_COLUMNS) + "\nEdge0\t1\tA\tA\ttrue\t2\tC\tC\tfalse\t0\t3\n"


def test_results_and_index(spark, tmp_path):
    strains = spark.createDataFrame([(0, "ACGTACGGTTACG", 13), (1, "ACGTACGCTTACG", 13)], "strain long, seq string, len long")
    for k in (4, 5):
        files.save_index(Graph(strains, k), str(tmp_path / "index"))
    for k in (4, 5):
        kept = files.load_index(spark, str(tmp_path / "index"), k)
        assert kept["nodes"].count() == Graph(strains, k).nodes.count() and kept["strains"].count() == 2
    with pytest.raises(ValueError, match="other strains"):
        files.save_index(Graph(strains.withColumn("strain", F.col("strain") + 1), 4), str(tmp_path / "index"))
    files.write_style(str(tmp_path / "style.xml"), 3)
    assert "#FF00FF" in (tmp_path / "style.xml").read_text()
    files.write_table(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).columns == ["a", "b"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">r1\nACG\nT\n>r2\nGG\n")
    out = str(tmp_path / "out")
    streams.map_stream(streams.stream_fasta(spark, str(tmp_path / "in")), lambda rows: rows.withColumn("n", F.length("seq")), out, str(tmp_path / "progress"), once=True).awaitTermination()
    assert sorted(tuple(r)[:3] for r in spark.read.parquet(out).collect()) == [("r1", "ACGT", 4), ("r2", "GG", 2)]


def test_contract():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(catalog.QUERIES) <= set(contract.queries())
    if importlib.util.find_spec("panweave.llm"):
        assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n if n == "pipeline" else n.split("_")[0] for n in contract.queries()}
