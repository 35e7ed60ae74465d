"""Queries on k-mers and the graph of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.functions import dna as D
from panweave.operators import sequences as S
from panweave.operators.graph import Graph, maximal
from panweave.plans import oracle as O
from panweave.plans.catalog import query
from panweave.sources import tables as T

K = 20


def graph(spark: SparkSession, sf_dir: str, k: int = K, *, nodes_only: bool = False) -> Graph:
    """The graph of all documents. It is built once for each application, like an index, and its tables are stored in
    the checkpoint folder. With ``nodes_only``, the whole graph if it is there, else one of nodes alone."""
    key = (spark.sparkContext.applicationId, sf_dir, k)
    if key not in _built and nodes_only:
        key = (*key, "nodes")
    if key not in _built:
        while len(_built) >= 6:
            _built.pop(next(iter(_built)))
        _built[key] = Graph(T.strains(spark, sf_dir, k), k, nodes_only=nodes_only)
    return _built[key]


_built: dict[tuple, Graph] = {}


@query(f"WITH {O.graph(K)} SELECT * FROM nodes")
def cdbg_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).nodes


@query(f"WITH {O.graph(K)} SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, strain, CAST(multiplicity AS BIGINT) AS multiplicity FROM edges")
def cdbg_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).edges.select("src", "dst", "strain", "multiplicity")


@query(f"WITH {O.graph(K)} SELECT CAST(node_id AS BIGINT) AS node_id, strain, CAST(seg_ord AS INTEGER) AS seg_ord, CAST(seg_start AS BIGINT) AS seg_start, CAST(seg_end AS BIGINT) AS seg_end FROM node_occ")
def node_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).node_occ.select("node_id", "strain", "seg_ord", "seg_start", F.col("seg_end").cast("long").alias("seg_end"))


STATS = """SELECT count(*) AS n_nodes, CAST(sum(CASE WHEN kind <> 'end' THEN multiplicity ELSE 0 END) AS BIGINT) AS n_edges,
  CAST(sum(len) AS BIGINT) AS total_len, CAST(sum(multiplicity) AS BIGINT) AS total_multiplicity, CAST(sum(len) AS DOUBLE) / count(*) AS mean_len,
  CAST(sum(multiplicity) AS DOUBLE) / count(*) AS mean_multiplicity, CAST(floor(median(len)) AS BIGINT) AS median_len,
  CAST(floor(median(multiplicity)) AS BIGINT) AS median_multiplicity FROM nodes"""


@query(f"WITH {O.graph(K)} {STATS}")
def cdbg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).stats()


KS = (16, 20, 24)


@query(" UNION ALL ".join(f"SELECT {k} AS k, * FROM (WITH {O.graph(k)} {STATS})" for k in KS))
def cdbg_stats_multi_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [graph(spark, sf_dir, k).stats().select(F.lit(k).alias("k"), "*") for k in KS]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {O.graph(K)} SELECT omega[p + 1 : p + {K}] AS kmer, CAST(node_id AS BIGINT) AS node_id, p AS "offset"
  FROM (SELECT node_id, omega, unnest(range(len(omega) - {K} + 1)) AS p FROM numbered WHERE kind <> 'end')""")
def kmer_to_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir, nodes_only=True).kmer_to_node()


def _neighbours(here: str, there: str, character: str) -> str:
    return f"""WITH {O.graph(K)} SELECT DISTINCT CAST(e.{here} AS BIGINT) AS node_id, {character} AS character, CAST(e.{there} AS BIGINT) AS neighbour
  FROM edges e JOIN nodes n ON n.node_id = e.{there}"""


@query(_neighbours("src", "dst", f"n.omega[{K} : {K}]"))
def node_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).neighbours(True)


@query(_neighbours("dst", "src", f"n.omega[n.len - {K} + 1 : n.len - {K} + 1]"))
def node_predecessors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).neighbours(False)


@query(f"WITH {O.graph(K)} SELECT node_id, CASE WHEN len <= 15 THEN omega ELSE left(omega, 5) || '..(+' || (len - 10) || ')..' || right(omega, 5) END AS omega_short FROM nodes")
def omega_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph(spark, sf_dir).nodes.select("node_id", D.short_label(F.col("omega")).alias("omega_short"))


def _maximal(side: str) -> str:
    return f"WITH {O.strains(K)}, {O.kmers(K)} SELECT gram AS kmer, count(*) AS n, count(DISTINCT {side}) AS n_sides FROM kmers GROUP BY gram HAVING count(DISTINCT {side}) > 1"


@query(_maximal("next"))
def right_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal(T.strains(spark, sf_dir, K), K, True)


@query(_maximal("prev"))
def left_maximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal(T.strains(spark, sf_dir, K), K, False)


WORD = 4


@query(f"WITH {O.strains(WORD)} SELECT word, count(*) AS n, CAST(coalesce(sum(count(*)) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_rank "
       f"FROM (SELECT seq[p + 1 : p + {WORD}] AS word FROM (SELECT seq, unnest(range(len - {WORD} + 1)) AS p FROM strains)) GROUP BY word")  # fmt: skip
def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of four bases with their counts and the rank of their first occurrence in sorted order: at most 256 rows."""
    from pyspark.sql.window import Window

    counts = S.windows(T.strains(spark, sf_dir, WORD), WORD).groupBy(F.col("gram").alias("word")).agg(F.count("*").alias("n"))
    before = Window.orderBy("word").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first_rank", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query(f"WITH {O.strains(1)} SELECT ch, n, CAST(coalesce(sum(n) OVER (ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS smaller FROM ("
       "SELECT ch, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['A', 'C', 'G', 'T']) AS ch, unnest([len - len(replace(seq, 'A', '')), len - len(replace(seq, 'C', '')), len - len(replace(seq, 'G', '')), len - len(replace(seq, 'T', ''))]) AS n FROM strains) GROUP BY ch "
       "UNION ALL SELECT '%', count(*) - 1 FROM strains UNION ALL SELECT '$', 1)")  # fmt: skip
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of the whole text (strains, "%" between them, "$" at the end) and how many are smaller. Six rows."""
    from pyspark.sql.window import Window

    strains = T.strains(spark, sf_dir, 1)
    sums = strains.agg(*(F.sum(F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))).alias(c) for c in "ACGT"), F.count("*").alias("n"))
    rows = [F.struct(F.lit(c).alias("ch"), F.col(c).cast("long").alias("n")) for c in "ACGT"] + [F.struct(F.lit("%").alias("ch"), (F.col("n") - 1).alias("n")), F.struct(F.lit("$").alias("ch"), F.lit(1).cast("long").alias("n"))]
    before = Window.orderBy("ch").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.inline(F.array(*rows))).withColumn("smaller", F.coalesce(F.sum("n").over(before), F.lit(0)))


@query(f"SELECT doc_id AS strain, {O.revcomp(O.dna('text'))} AS seq FROM documents")
def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("strain"), D.revcomp(D.dna(F.col("text"))).alias("seq"))


#: Letters of texts as IUPAC codes: those that are none become N.
_IUPAC_FROM, _IUPAC_TO = "EFIJLOPQUXZ", "NNNNNNNNNNN"
_IUPAC_SQL = f"translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_IUPAC_FROM}', '{_IUPAC_TO}')"


def _iupac_text():
    return F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), _IUPAC_FROM, _IUPAC_TO)


_IUPAC_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in D.IUPAC.items()) + "}"
_CLEAN_SQL = f"""array_to_string(list_transform(string_split(s, ''), lambda c, i: CASE WHEN c IN ('A', 'C', 'G', 'T') THEN c
  ELSE substr({_IUPAC_MAP}[c], CAST((i - 1) % len({_IUPAC_MAP}[c]) + 1 AS BIGINT), 1) END), '')"""


@query(f"SELECT doc_id, CASE WHEN s = '' THEN '' ELSE {_CLEAN_SQL} END AS seq FROM (SELECT doc_id, {_IUPAC_SQL} AS s FROM documents)")
def iupac_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's letters as IUPAC codes, made unambiguous."""
    return T.table(spark, sf_dir, "documents").select("doc_id", D.iupac_clean(_iupac_text()).alias("seq"))


@query(f"""WITH t AS (SELECT s, {_CLEAN_SQL} AS c FROM (SELECT {_IUPAC_SQL} AS s FROM documents) WHERE s <> ''),
b AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS ch FROM t) GROUP BY ch),
a AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(c, '')) AS ch FROM t) GROUP BY ch)
SELECT coalesce(b.ch, a.ch) AS ch, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after FROM b FULL JOIN a ON a.ch = b.ch""")
def substitution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.table(spark, sf_dir, "documents").select(_iupac_text().alias("s"))
    count = lambda c, name: text.select(F.explode(F.split(c, "")).alias("ch")).filter("ch <> ''").groupBy("ch").agg(F.count("*").alias(name))
    both = count(F.col("s"), "n_before").join(count(D.iupac_clean(F.col("s")), "n_after"), "ch", "full")
    return both.select("ch", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


CODE_K = 12
_CODE_SQL = "list_reduce(list_transform(string_split(translate(gram, 'ACGT', '0123'), ''), lambda c: CAST(c AS BIGINT)), lambda a, x: a * 4 + x)"


@query(f"WITH {O.strains(CODE_K)}, {O.kmers(CODE_K)} SELECT gram AS kmer, any_value({_CODE_SQL}) AS code, count(*) AS n FROM kmers GROUP BY gram")
def kmer_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers with their two-bit code."""
    counts = S.windows(T.strains(spark, sf_dir, CODE_K), CODE_K).groupBy(F.col("gram").alias("kmer")).agg(F.count("*").alias("n"))
    return counts.select("kmer", D.kmer_code(F.col("kmer")).alias("code"), "n")


@query(f"WITH {O.strains(CODE_K)}, {O.kmers(CODE_K)} SELECT least(gram, {O.revcomp('gram')}) AS kmer, count(*) AS n FROM kmers GROUP BY 1")
def canonical_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical k-mers with their counts. Plain k-mers are counted first, so only distinct ones are turned round."""
    counts = S.windows(T.strains(spark, sf_dir, CODE_K), CODE_K).groupBy("gram").agg(F.count("*").alias("n"))
    return counts.groupBy(D.canonical(F.col("gram")).alias("kmer")).agg(F.sum("n").alias("n"))


@query(f"WITH {O.strains(K)}, {O.starts()} SELECT strain, start, start + len AS separator_at, CASE WHEN strain = (SELECT max(strain) FROM strains) THEN '$' ELSE '%' END AS separator FROM starts")
def text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each strain and its separator lie in the whole text."""
    placed = S.with_starts(T.strains(spark, sf_dir, K).select("strain", "seq", "len"))
    last = placed.agg(F.max("strain").alias("last"))
    separator = F.when(F.col("strain") == F.col("last"), "$").otherwise("%")
    return placed.crossJoin(F.broadcast(last)).select("strain", "start", (F.col("start") + F.col("len")).alias("separator_at"), separator.alias("separator"))


@query(f"SELECT doc_id, count(*) AS n_strains, CAST(sum(len({O.dna('part')})) AS BIGINT) AS n_bases FROM (SELECT doc_id, unnest(string_split(replace(text, '\n', '%') || '$', '%')) AS part FROM documents) GROUP BY doc_id")
def text_strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as preprocessed texts whose lines are strains: strains and bases of each."""
    parts = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit("%")), "%")).alias("part"))
    return parts.groupBy("doc_id").agg(F.count("*").alias("n_strains"), F.sum(F.length(D.dna(F.col("part")))).cast("long").alias("n_bases"))
