"""Queries on search schemes, subgraphs, strain-free walks, index views and files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.functions import dna as D
from panweave.operators import packed_index as I
from panweave.operators import paths as P
from panweave.operators import schemes, walks
from panweave.operators import sequences as S
from panweave.operators import subgraph as G
from panweave.operators import text_index as X
from panweave.operators.graph import Graph
from panweave.operators.ranking import cut, drop, stored
from panweave.plans import match_queries as Q
from panweave.plans import oracle as O
from panweave.plans import scheme_values as V
from panweave.plans.catalog import query
from panweave.plans.graph_queries import K, graph
from panweave.sources import files
from panweave.sources import tables as T
from panweave.streaming import reads as R

# Search schemes


_TEXT = "list_transform({}, lambda x: CAST(x AS VARCHAR))"


@query(f"WITH {V.values_sql()} SELECT scheme, CAST(k AS INTEGER) AS k, CAST(search_no AS INTEGER) AS search_no, " + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("ord", "lo", "hi")) + " FROM scheme")
def scheme_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemes.scheme_table(spark).select("scheme", "k", "search_no", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("ord", "lo", "hi")))


@query(f"""WITH RECURSIVE {V.values_sql()}, sizes AS (SELECT scheme, k, max(len(ord)) AS parts, count(*) AS searches FROM scheme GROUP BY scheme, k),
spread(scheme, k, parts, pattern, used) AS (SELECT scheme, k, parts, CAST([] AS INTEGER[]), 0 FROM sizes
  UNION ALL SELECT scheme, k, parts, list_append(pattern, CAST(e AS INTEGER)), used + CAST(e AS INTEGER) FROM spread, (SELECT unnest(range(6)) AS e) WHERE len(pattern) < parts AND used + e <= k),
held AS (SELECT p.scheme, p.k, p.pattern, len(list_filter(range(1, p.parts + 1), lambda i: NOT (list_sum(list_transform(ord[1 : i], lambda o: pattern[o + 1])) BETWEEN lo[i] AND hi[i]))) = 0 AS ok
  FROM spread p JOIN scheme s ON p.scheme = s.scheme AND p.k = s.k WHERE len(p.pattern) = p.parts),
n AS (SELECT scheme, k, pattern, count(*) FILTER (ok) AS n FROM held GROUP BY scheme, k, pattern)
SELECT scheme, CAST(k AS INTEGER) AS k, CAST(any_value(parts) AS INTEGER) AS parts, any_value(searches) AS searches, count(*) AS patterns, count(*) FILTER (n > 0) AS covered, count(*) FILTER (n > 1) AS covered_twice
  FROM n JOIN sizes USING (scheme, k) GROUP BY scheme, k""")
def scheme_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemes.coverage(schemes.scheme_table(spark))


def _validation_sql() -> str:
    rows = ", ".join(f"('{name}', {k}, '{kinds}')" for name, k, _, kinds in V.bad_rows())
    return f"WITH {V.values_sql()} SELECT scheme, CAST(k AS INTEGER) AS k, '' AS faults FROM scheme GROUP BY scheme, k UNION ALL SELECT * FROM (VALUES {rows}) AS b(scheme, k, faults)"


@query(_validation_sql())
def scheme_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of faults found in each built-in scheme, and in some made with faults."""
    rows = [(n, k, schemes.searches(n, k)) for n, k in schemes.supported()]
    digits = lambda x: tuple(map(int, x))
    rows += [(name, k, [schemes.Search(*map(digits, s.split("-"))) for s in text]) for name, k, text, _ in V.bad_rows()]
    kinds = lambda found: ",".join(sorted({x.rpartition(": ")[2].replace(" ", "_") if x.startswith("search") else x.partition(":")[0] for x in found}))
    return spark.createDataFrame([(n, k, kinds(schemes.validate(s, k))) for n, k, s in rows], "scheme string, k int, faults string")


_PARTS = 4


@query(f"""WITH {Q._reads_sql(False)} SELECT read_id, CAST(i AS INTEGER) AS part, CAST(len(seq) * i // {_PARTS} AS INTEGER) AS begin, CAST(CASE WHEN i = {_PARTS - 1} THEN len(seq) ELSE len(seq) * (i + 1) // {_PARTS} END AS INTEGER) AS "end"
  FROM reads, (SELECT unnest(range({_PARTS})) AS i)""")
def partition_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reads(spark, sf_dir, Q.LENGTH).select("read_id", F.inline(schemes.uniform_parts(F.length("seq"), _PARTS)))


#: Begins of the parts of the scheme that the query uses, as fractions.
_BEGINS = [0.25, 0.44, 0.61, 0.81]


@query(f"""WITH {Q._reads_sql(False)}, f AS (SELECT unnest([0.0, {', '.join(map(str, _BEGINS))}]) AS f, unnest(range({len(_BEGINS) + 1})) AS i, unnest([{', '.join(map(str, _BEGINS))}, 1.0]) AS g)
SELECT read_id, CAST(i AS INTEGER) AS part, CAST(floor(len(seq) * CAST(f AS DOUBLE)) AS INTEGER) AS begin, CAST(floor(len(seq) * CAST(g AS DOUBLE)) AS INTEGER) AS "end" FROM reads, f""")
def partition_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reads(spark, sf_dir, Q.LENGTH).select("read_id", F.inline(schemes.static_parts(F.length("seq"), schemes.static_begins("kuch_k+1_adapted", 4))))


def _dynamic_sql() -> str:
    chosen = schemes.searches(schemes.DEFAULT, Q.ERRORS)
    spans = sorted({(min(x.order[: x.exact_parts]), max(x.order[: x.exact_parts])) for x in chosen})
    parts, begins = len(chosen[0].order), [0.0, *schemes.static_begins(schemes.DEFAULT, Q.ERRORS), 1.0]
    even = [(f"len(seq) * {a} // {parts}", f"len(seq) * {b + 1} // {parts}") for a, b in spans]
    uneven = [(f"CAST(floor(len(seq) * CAST({begins[a]} AS DOUBLE)) AS BIGINT)", f"CAST(floor(len(seq) * CAST({begins[b + 1]} AS DOUBLE)) AS BIGINT)") for a, b in spans]

    def cost(name: str, ends: list) -> str:
        words = " UNION ALL ".join(f"SELECT read_id, rc, seq[({a}) + 1 : ({a}) + {Q.WORD}] AS gram, ({b}) - ({a}) AS n FROM ways" for a, b in ends)
        # Seeds too short for a word count as no hits.
        return f"{name} AS (SELECT read_id, rc, CAST(sum(CASE WHEN s.n >= {Q.WORD} THEN coalesce(c.n, 0) ELSE 0 END) AS BIGINT) AS {name} FROM ({words}) s LEFT JOIN counts c USING (gram) GROUP BY read_id, rc)"

    return f"""WITH {O.strains(K)}, {O.kmers(Q.WORD)}, {Q._reads_sql(True)}, counts AS (SELECT gram, count(*) AS n FROM kmers GROUP BY gram), {cost('uniform', even)}, {cost('static', uneven)}
SELECT read_id, CAST(rc AS INTEGER) AS rc, uniform, static, CASE WHEN static < uniform THEN 'static' ELSE 'uniform' END AS partition FROM uniform JOIN static USING (read_id, rc)"""


@query(_dynamic_sql())
def partition_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the uniform and the static partition, for each read the one whose rarest seeds promise fewer hits.

    Any partition gives the same matches; this picks the cheaper one from counts of the text's words."""
    reads = S.both_ways(T.changed_reads(spark, sf_dir, Q.LENGTH))
    counts = S.windows(T.strains(spark, sf_dir, K), Q.WORD).groupBy("gram").agg(F.count("*").alias("n"))
    from panweave.operators import matching as M

    cost = lambda p: M.seeds(reads, Q.ERRORS, schemes.DEFAULT, partition=p).select("read_id", "rc", F.substring("word", 1, Q.WORD).alias("gram")).join(counts, "gram", "left").groupBy("read_id", "rc").agg(F.sum(F.coalesce("n", F.lit(0))).alias(p))
    both = cost("uniform").join(cost("static"), ["read_id", "rc"])
    return both.withColumn("partition", F.when(F.col("static") < F.col("uniform"), "static").otherwise("uniform"))


# Subgraphs

DEPTH = 2


def _path_nodes(spark: SparkSession, sf_dir: str, g: Graph) -> DataFrame:
    """read_id, rc, path, node_id of every path of an exact match."""
    found = Q.M.exact_occurrences(Q._both(spark, sf_dir, False), g.strains).select(*Q.COLUMNS)
    return P.subgraph_ids(P.node_paths(found, g))


_PATHS = f"""{Q._EXACT}, {Q._GRAPH}, {Q._paths_sql('found')}, path_nodes AS MATERIALIZED (SELECT DISTINCT read_id, unnest(nodes) AS node_id FROM paths)"""
_AROUND = f"""both_ways AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges),
hops0 AS MATERIALIZED (SELECT read_id, node_id, 0 AS hops FROM path_nodes),
hops1 AS MATERIALIZED (SELECT DISTINCT read_id, b AS node_id, 1 AS hops FROM hops0 JOIN both_ways ON a = node_id),
hops2 AS MATERIALIZED (SELECT DISTINCT read_id, b AS node_id, 2 AS hops FROM hops1 JOIN both_ways ON a = node_id),
around AS MATERIALIZED (SELECT read_id, node_id, min(hops) AS hops FROM (SELECT * FROM hops0 UNION ALL SELECT * FROM hops1 UNION ALL SELECT * FROM hops2) GROUP BY read_id, node_id)"""


def _around(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame, DataFrame]:
    g = graph(spark, sf_dir)
    starts = cut(_path_nodes(spark, sf_dir, g).select("read_id", F.explode("path").alias("node_id")).distinct())
    return g, starts, G.neighbourhood(starts, g, DEPTH, keys=("read_id",))


@query(f"WITH {_PATHS}, {_AROUND} SELECT read_id, CAST(node_id AS BIGINT) AS node_id, CAST(hops AS INTEGER) AS hops FROM around")
def neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps of each read's paths."""
    return _around(spark, sf_dir)[2]


_LABEL = "CASE WHEN len({0}) <= 15 THEN {0} ELSE left({0}, 5) || '..(+' || (len({0}) - 10) || ')..' || right({0}, 5) END"
_NAMED = f"""SELECT i.read_id, CAST(i.src AS BIGINT) AS src, CAST(i.dst AS BIGINT) AS dst, i.color, CAST(i.multiplicity AS BIGINT) AS multiplicity,
  {_LABEL.format('a.omega')} AS src_omega_short, {_LABEL.format('b.omega')} AS dst_omega_short,
  EXISTS (SELECT 1 FROM path_nodes p WHERE p.read_id = i.read_id AND p.node_id = i.src) AS src_part_of_path, EXISTS (SELECT 1 FROM path_nodes p WHERE p.read_id = i.read_id AND p.node_id = i.dst) AS dst_part_of_path
  FROM inside i JOIN nodes a ON a.node_id = i.src JOIN nodes b ON b.node_id = i.dst"""
_EDGE_COLUMNS = ["read_id", "src", "dst", "color", "multiplicity", "src_omega_short", "dst_omega_short", "src_part_of_path", "dst_part_of_path"]


@query(f"""WITH {_PATHS}, {_AROUND}, inside AS MATERIALIZED (SELECT x.read_id, src, dst, CAST(strain AS VARCHAR) AS color, multiplicity FROM edges JOIN around x ON x.node_id = src JOIN around y ON y.node_id = dst AND y.read_id = x.read_id) {_NAMED}""")
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, starts, nodes = _around(spark, sf_dir)
    return G.subgraph_edges(nodes, g, starts, keys=("read_id",)).select(*_EDGE_COLUMNS)


@query(f"""WITH {_PATHS}, {_AROUND}, inside AS MATERIALIZED (SELECT x.read_id, src, dst, string_agg(strain || ':' || multiplicity, ',' ORDER BY strain) AS color, sum(multiplicity) AS multiplicity
  FROM edges JOIN around x ON x.node_id = src JOIN around y ON y.node_id = dst AND y.read_id = x.read_id GROUP BY x.read_id, src, dst) {_NAMED}""")
def subgraph_edges_bundled(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, starts, nodes = _around(spark, sf_dir)
    return G.subgraph_edges(nodes, g, starts, keys=("read_id",), separate=False).select(*_EDGE_COLUMNS)


@query(f"""WITH {_PATHS} SELECT p.read_id, CAST(dense_rank() OVER (PARTITION BY p.read_id ORDER BY p.rc, p.nodes) - 1 AS INTEGER) AS "SubgraphID", p.path AS "Path", CAST(p.dist_left AS BIGINT) AS "DistanceFromLeftEnd",
  p.strain AS "Strain", CAST(s.start + p.begin AS BIGINT) AS "Position", CAST(p.length AS INTEGER) AS "Length", CAST(p.ed AS INTEGER) AS "ED" FROM paths p JOIN starts s USING (strain)""")
def subgraph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir)
    found = _path_nodes(spark, sf_dir, g).join(Q._starts(spark, sf_dir).select("strain", "start"), "strain")
    return found.select(
        "read_id", F.col("subgraph_id").alias("SubgraphID"), P.path_string(F.col("path"), F.col("length"), K).alias("Path"), F.col("dist_left").alias("DistanceFromLeftEnd"),
        F.col("strain").alias("Strain"), (F.col("start") + F.col("begin")).alias("Position"), F.col("length").alias("Length"), F.col("ed").alias("ED"),
    )


# Strain-free walks


@query(f"""WITH {Q._EXACT}, {Q._GRAPH},
k2n AS MATERIALIZED (SELECT omega[p + 1 : p + {K}] AS kmer, node_id, p, len(omega) - {K} AS last FROM (SELECT node_id, omega, unnest(range(len(omega) - {K} + 1)) AS p FROM numbered WHERE kind <> 'end')),
grams AS (SELECT read_id, rc, m, i, seq[i + 1 : i + {K}] AS kmer FROM (SELECT read_id, rc, seq, len(seq) AS m, unnest(range(len(seq) - {K} + 1)) AS i FROM ways WHERE len(seq) >= {K})),
met AS (SELECT g.*, n.node_id, n.p, lag(n.node_id) OVER w AS before, lag(n.p) OVER w AS p_before, lag(n.last) OVER w AS last_before, lag(i) OVER w AS i_before FROM grams g JOIN k2n n USING (kmer) WINDOW w AS (PARTITION BY read_id, rc ORDER BY i)),
checked AS (SELECT *, before IS NULL OR NOT (node_id = before AND p = p_before + 1) AS enters, CASE WHEN before IS NULL THEN i = 0 ELSE i = i_before + 1 AND ((node_id = before AND p = p_before + 1)
  OR (p = 0 AND p_before = last_before AND EXISTS (SELECT 1 FROM edges e WHERE e.src = before AND e.dst = node_id))) END AS fine FROM met)
SELECT read_id, CAST(rc AS INTEGER) AS rc, string_agg(node_id, ',' ORDER BY i) FILTER (enters) AS path, arg_min(p, i) AS dist_left, CAST(any_value(m) AS INTEGER) AS length, 0 AS ed
  FROM checked GROUP BY read_id, rc HAVING count(*) = any_value(m) - {K} + 1 AND bool_and(fine)""")
def strain_free_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_strings(walks.exact_walks(Q._both(spark, sf_dir, False), graph(spark, sf_dir)))


def _edit_walks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Graph]:
    g = graph(spark, sf_dir, nodes_only=True)
    return cut(walks.edit_walks(Q._both(spark, sf_dir), g, Q.ERRORS)), g


def _walk_strings(found: DataFrame) -> DataFrame:
    return found.withColumn("path", P.path_string(F.col("path"), F.lit(K), K))


@query()
def strain_free_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_strings(_edit_walks(spark, sf_dir)[0])


@query()
def sfr_same_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _walk_strings(walks.same_path(_edit_walks(spark, sf_dir)[0], Q.ERRORS))


@query()
def sfr_filter_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, g = _edit_walks(spark, sf_dir)
    return _walk_strings(walks.filter_complete(walks.same_path(found, Q.ERRORS), g, Q.ERRORS))


@query()
def sfr_filter_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, g = _edit_walks(spark, sf_dir)
    return _walk_strings(walks.filter_linear(walks.same_path(found, Q.ERRORS), g, Q.ERRORS))


@query()
def map_strain_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strain-free results with the columns of the result file."""
    found, g = _edit_walks(spark, sf_dir)
    kept = P.subgraph_ids(walks.filter_linear(walks.same_path(found, Q.ERRORS), g, Q.ERRORS))
    return kept.select(
        F.col("read_id").cast("string").alias("Identifier"), F.col("subgraph_id").alias("SubgraphID"), P.path_string(F.col("path"), F.col("length"), K).alias("Path"),
        F.col("dist_left").alias("DistanceFromLeftEnd"), F.col("length").alias("Length"), F.col("ed").alias("ED"), F.col("rc").alias("reverseComplement"),
    )


# Index views, over all strains

#: Doublings that the SQL makes: it compares 2^17 characters, more than any repeat of the tables that it is run on.
DOUBLINGS = 13


def _text_sql(turned: bool = False) -> str:
    seq, order = ("reverse(seq)", "strain DESC") if turned else ("seq", "strain")
    key = " || ".join(["ch", *(f"coalesce(lead(ch, {i}) OVER w, '')" for i in range(1, 16))])
    steps = [f"""s{i + 1} AS MATERIALIZED (SELECT pos, rank() OVER (ORDER BY r, next) - 1 AS r FROM (SELECT pos, r, coalesce(lead(r, {16 << i}) OVER (ORDER BY pos), -1) AS next FROM s{i}))""" for i in range(DOUBLINGS)]
    return f"""texts AS MATERIALIZED (SELECT number, seq || CASE WHEN number = max(number) OVER () THEN '$' ELSE '%' END AS seq
  FROM (SELECT row_number() OVER (ORDER BY {order}) AS number, {seq} AS seq FROM (SELECT doc_id AS strain, {O.dna('text')} AS seq FROM documents) WHERE seq <> '')),
characters AS MATERIALIZED (SELECT row_number() OVER (ORDER BY number, i) - 1 AS pos, ch FROM (SELECT number, unnest(string_split(seq, '')) AS ch, generate_subscripts(string_split(seq, ''), 1) AS i FROM texts)),
s0 AS MATERIALIZED (SELECT pos, rank() OVER (ORDER BY key) - 1 AS r FROM (SELECT pos, {key} AS key FROM characters WINDOW w AS (ORDER BY pos))),
{", ".join(steps)},
suffixes AS MATERIALIZED (SELECT r AS row, pos FROM s{DOUBLINGS}),
transform AS MATERIALIZED (SELECT row, before AS ch FROM suffixes JOIN (SELECT pos, coalesce(lag(ch) OVER (ORDER BY pos), '$') AS before FROM characters) USING (pos))"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.strains(spark, sf_dir, 1)


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of the text and its suffix array, both stored; for each folder built once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        while len(_indexes) >= 4:
            _indexes.pop(next(iter(_indexes)))
        blocks = cut(X.text_blocks(_texts(spark, sf_dir)))
        _indexes[key] = blocks, cut(X.suffix_array(blocks))
    return _indexes[key]


def _transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, array = _index(spark, sf_dir)
    return X.bwt(array, X.characters(blocks))


_indexes: dict[tuple, tuple[DataFrame, DataFrame]] = {}

#: One place in so many has its place stored.
SPARSE = 16


def _packed(spark: SparkSession, sf_dir: str) -> I.Transform:
    """The packed transform with its sampled places, stored; for each folder built once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _transforms:
        while len(_transforms) >= 4:
            _transforms.pop(next(iter(_transforms)))
        texts = stored(I.bases(T.spread(T.table(spark, sf_dir, "documents").select("doc_id", "text"))))
        _transforms[key] = I.Transform(X.text_blocks(texts), SPARSE)
        drop(texts)
    return _transforms[key]


_transforms: dict[tuple, I.Transform] = {}


@query(f"WITH {_text_sql()} SELECT row, pos FROM suffixes")
def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1]


@query(f"WITH {_text_sql()} SELECT row, ch FROM transform")
def bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).rows()


@query(f"WITH {_text_sql(True)} SELECT row, ch FROM transform")
def rev_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform of the reversed text, its end mark last."""
    turned = _texts(spark, sf_dir).select((-F.col("strain")).alias("strain"), F.reverse("seq").alias("seq"))
    blocks = cut(X.text_blocks(turned))
    return X.bwt(X.suffix_array(blocks), X.characters(blocks))


@query(f"WITH {_text_sql()} SELECT row, ch, CAST(row_number() OVER (PARTITION BY ch ORDER BY row) - 1 AS BIGINT) AS occ FROM transform")
def bwt_occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.occurrences(cut(_transform(spark, sf_dir)))


@query(f"WITH {_text_sql()} SELECT row, CAST(row_number() OVER (ORDER BY ch, row) - 1 AS BIGINT) AS lf FROM transform")
def lf_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.last_to_first(cut(_transform(spark, sf_dir)))


@query(f"WITH {_text_sql()} SELECT row, pos FROM suffixes WHERE pos % {SPARSE} = 0")
def sparse_sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[1].filter(F.col("pos") % SPARSE == 0)


LCP_K = 8


@query(f"""WITH {_text_sql()}, starts AS (SELECT pos, string_agg(ch, '') OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LCP_K} FOLLOWING) AS s FROM characters)
SELECT row, CASE WHEN above IS NULL THEN 0 WHEN s = above THEN 2 WHEN left(s, {LCP_K}) = left(above, {LCP_K}) THEN 1 ELSE 0 END AS "class"
  FROM (SELECT row, s, lag(s) OVER (ORDER BY row) AS above FROM suffixes JOIN starts USING (pos))""")
def lcp_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, array = _index(spark, sf_dir)
    return X.lcp_classes(array, X.grams(blocks, LCP_K + 1), LCP_K)


@query(f"""WITH {_text_sql()}, letters AS (SELECT unnest(['$', '%', 'A', 'C', 'G', 'T']) AS ch),
above AS (SELECT t.row, l.ch, CAST(coalesce(sum(CASE WHEN t.ch = l.ch THEN 1 ELSE 0 END) OVER (PARTITION BY l.ch ORDER BY t.row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS occ FROM transform t, letters l)
SELECT row, ch, occ, CAST(coalesce(sum(occ) OVER (PARTITION BY row ORDER BY ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum_occ FROM above""")
def bwt_rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).rank_table()


@query(f"WITH {_text_sql()} SELECT row, pos FROM suffixes")
def find_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of all rows from the sampled ones, by walks through the transform."""
    return _packed(spark, sf_dir).positions()


# Files and streams


def _folder(spark: SparkSession, name: str) -> str:
    cut(spark.range(1))  # sets the shared folder where it is unset
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_READS_TEXT = f"SELECT CAST(read_id AS VARCHAR) AS read_id, seq FROM (WITH {Q._reads_sql(False)} SELECT * FROM reads)"


@query(_READS_TEXT.replace("CAST(read_id AS VARCHAR)", "read_id || ' A->G'"))
def fasta_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTA and read back; headers hold the character that records begin with."""
    path = _folder(spark, "reads")
    files.write_fasta(T.reads(spark, sf_dir, Q.LENGTH).withColumn("read_id", F.concat(F.col("read_id").cast("string"), F.lit(" A->G"))), path)
    return files.fasta_reads(spark, path, glob="*")


@query(_READS_TEXT)
def fastq_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ and read back."""
    path = _folder(spark, "reads")
    lines = T.reads(spark, sf_dir, Q.LENGTH).select(F.concat(F.lit("@"), F.col("read_id").cast("string"), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.translate("seq", "ACGT", "@@@@")).alias("value"))
    lines.write.text(path)
    return files.fastq_reads(spark, path)


@query(_READS_TEXT)
def csv_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "reads")
    T.reads(spark, sf_dir, Q.LENGTH).select(F.lit("").alias("index"), F.col("read_id").alias("position"), "seq").write.option("header", True).csv(path)
    return files.csv_reads(spark, path)


@query(f"SELECT CAST(item_id AS VARCHAR) AS name, {O.dna('text')} AS seq FROM benchmark")
def fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages written as FASTA and read back, each record a strain of its own."""
    path = _folder(spark, "genomes")
    files.write_fasta(T.table(spark, sf_dir, "benchmark").select("item_id", D.dna(F.col("text")).alias("seq")), path, header="item_id")
    return files.fasta_contigs(spark, path, glob="*").select("name", "seq")


@query(f"WITH {Q._EXACT} SELECT CAST(read_id AS VARCHAR) AS read_id, CAST(rc AS INTEGER) AS rc, strain, CAST(begin AS BIGINT) AS begin FROM found")
def stream_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTA, read as a stream and mapped batch by batch."""
    path, out = _folder(spark, "reads"), _folder(spark, "stream")
    files.write_fasta(T.reads(spark, sf_dir, Q.LENGTH), path)
    strains = T.strains(spark, sf_dir, K)
    mapped = lambda rows: Q.M.exact_occurrences(S.both_ways(S.without_n(rows)), strains)
    R.map_stream(R.stream_fasta(spark, path), mapped, out, f"{out}-progress", once=True).awaitTermination()
    return spark.read.parquet(out).select("read_id", "rc", "strain", "begin")


# Parts of results by themselves


@query(f"WITH {_PATHS} SELECT read_id, CAST(rc AS INTEGER) AS rc, strain, CAST(begin AS BIGINT) AS begin, CAST(unnest(range(len(nodes))) AS INTEGER) AS step, CAST(unnest(nodes) AS BIGINT) AS node_id FROM paths")
def match_node_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each exact match in order."""
    found = _path_nodes(spark, sf_dir, graph(spark, sf_dir))
    return found.select("read_id", "rc", "strain", "begin", F.posexplode("path").alias("step", "node_id"))


@query(f"WITH {_PATHS} SELECT path, count(*) AS n FROM paths GROUP BY path")
def path_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _path_nodes(spark, sf_dir, graph(spark, sf_dir))
    return found.select(P.path_string(F.col("path"), F.col("length"), K).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query(f"WITH {_PATHS} SELECT DISTINCT read_id, CAST(rc AS INTEGER) AS rc, path, CAST(dense_rank() OVER (PARTITION BY read_id ORDER BY rc, nodes) - 1 AS INTEGER) AS subgraph_id FROM paths")
def subgraph_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _path_nodes(spark, sf_dir, graph(spark, sf_dir))
    return found.select("read_id", "rc", P.path_string(F.col("path"), F.col("length"), K).alias("path"), "subgraph_id").distinct()


_KEYED = f"""{_PATHS}, named AS MATERIALIZED (SELECT DISTINCT path, nodes FROM paths), path_of AS MATERIALIZED (SELECT path, unnest(nodes) AS node_id FROM named),
pairs AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges),
around AS MATERIALIZED (SELECT path, node_id FROM path_of UNION SELECT path, b FROM path_of JOIN pairs ON a = node_id)"""


@query(f"""WITH {_KEYED} SELECT x.path || '_Edge' || (row_number() OVER (PARTITION BY x.path ORDER BY e.src, e.dst, e.strain) - 1) AS edge_key, x.path, CAST(e.src AS BIGINT) AS src, CAST(e.dst AS BIGINT) AS dst, e.strain AS color, CAST(e.multiplicity AS BIGINT) AS multiplicity
  FROM edges e JOIN around x ON x.node_id = e.src JOIN around y ON y.node_id = e.dst AND y.path = x.path""")
def visualize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each node path, given as text, the edges among the nodes within one step of it."""
    from pyspark.sql.window import Window

    g = graph(spark, sf_dir)
    named = path_string(spark, sf_dir).select("path")
    starts = cut(named.select("path", F.explode(F.split("path", ",")).alias("id")).select("path", F.col("id").cast("long").alias("node_id")).distinct())
    rows = G.subgraph_edges(G.neighbourhood(starts, g, 1, keys=("path",)), g, starts, keys=("path",))
    number = F.row_number().over(Window.partitionBy("path").orderBy("src", "dst", F.col("color").cast("long"))) - 1
    return rows.select(F.concat("path", F.lit("_Edge"), number.cast("string")).alias("edge_key"), "path", "src", "dst", F.col("color").cast("long").alias("color"), "multiplicity")


_PICTURES = f"""{Q._EXACT}, {Q._GRAPH}, {Q._paths_sql('found')},
pictures AS MATERIALIZED (SELECT DISTINCT read_id, sid, nodes FROM (SELECT read_id, nodes, dense_rank() OVER (PARTITION BY read_id ORDER BY rc, nodes) - 1 AS sid FROM paths)),
path_nodes AS MATERIALIZED (SELECT DISTINCT read_id, sid, unnest(nodes) AS node_id FROM pictures),
both_ways AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges),
around1 AS MATERIALIZED (SELECT * FROM path_nodes UNION SELECT read_id, sid, b FROM path_nodes JOIN both_ways ON a = node_id),
around AS MATERIALIZED (SELECT * FROM around1 UNION SELECT read_id, sid, b FROM around1 JOIN both_ways ON a = node_id),
inside AS MATERIALIZED (SELECT x.read_id, x.sid, src, dst, strain, multiplicity FROM edges JOIN around x ON x.node_id = src JOIN around y ON y.node_id = dst AND y.read_id = x.read_id AND y.sid = x.sid)"""


@query(f"""WITH {_PICTURES} SELECT i.read_id, 'Subgraph' || i.sid || '_Edge' || (row_number() OVER (PARTITION BY i.read_id, i.sid ORDER BY i.src, i.dst, i.strain) - 1) AS "EdgeKey", CAST(i.src AS BIGINT) AS "Source",
  {_LABEL.format('a.omega')} AS "SourceOmegaShort", a.omega AS "SourceOmegaFull", EXISTS (SELECT 1 FROM path_nodes p WHERE p.read_id = i.read_id AND p.sid = i.sid AND p.node_id = i.src) AS "SourcePartOfPath",
  CAST(i.dst AS BIGINT) AS "Target", {_LABEL.format('b.omega')} AS "TargetOmegaShort", b.omega AS "TargetOmegaFull", EXISTS (SELECT 1 FROM path_nodes p WHERE p.read_id = i.read_id AND p.sid = i.sid AND p.node_id = i.dst) AS "TargetPartOfPath",
  CAST(i.strain AS VARCHAR) AS "Color", CAST(i.multiplicity AS BIGINT) AS "EdgeMultiplicity" FROM inside i JOIN nodes a ON a.node_id = i.src JOIN nodes b ON b.node_id = i.dst""")
def visualize_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of each read: for each of its paths (numbered as in ``subgraph_overview``) the edges around it, as an edge file has them."""
    g, keys = graph(spark, sf_dir), ("read_id", "subgraph_id")
    starts = cut(_path_nodes(spark, sf_dir, g).select(*keys, F.explode("path").alias("node_id")).distinct())
    edges = G.subgraph_edges(G.neighbourhood(starts, g, DEPTH, keys=keys), g, starts, keys=keys)
    named = G.keyed_edges(edges, *keys, prefix=F.concat(F.lit("Subgraph"), F.col("subgraph_id").cast("string"), F.lit("_")))
    sides = [F.col(f"{side}{was}").alias(f"{to}{name}") for side, to in (("src", "Source"), ("dst", "Target")) for was, name in (("", ""), ("_omega_short", "OmegaShort"), ("_omega_full", "OmegaFull"), ("_part_of_path", "PartOfPath"))]
    return named.select("read_id", F.col("edge_key").alias("EdgeKey"), *sides, F.col("color").alias("Color"), F.col("multiplicity").alias("EdgeMultiplicity"))


@query(f"""WITH {Q._EDIT}, {Q._BEST}, beside AS (SELECT *, lag(ed) OVER w AS l, lag(begin) OVER w AS lb, lead(ed) OVER w AS r, lead(begin) OVER w AS rb FROM best WINDOW w AS (PARTITION BY read_id, rc, strain ORDER BY begin))
SELECT {Q._INTS} FROM beside WHERE NOT coalesce(lb = begin - 1 AND l < ed, false) AND NOT coalesce(rb = begin + 1 AND r < ed, false)""")
def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches that no match at the next place to either side beats."""
    best = cut(Q.M.best_per_begin(Q._edit(spark, sf_dir)))
    keys = ["read_id", "rc", "strain", "begin"]
    beside = best.select(*keys[:3], F.explode(F.array(F.col("begin") - 1, F.col("begin") + 1)).alias("begin"), "ed")
    rival = beside.groupBy(*keys).agg(F.min("ed").alias("rival"))
    return best.join(rival, keys, "left").filter("rival is null or rival >= ed").select(*Q.COLUMNS)


@query(f"WITH {V.values_sql()} SELECT CAST(k AS INTEGER) AS k, CAST(search_no AS INTEGER) AS search_no, " + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("ord", "lo", "hi")) + " FROM scheme WHERE scheme = 'kuch_k+2'")
def custom_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scheme folder written on the driver, read back and validated."""
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        with open(os.path.join(folder, "name.txt"), "w") as f:
            f.write("own")
        for k in range(1, 5):
            os.mkdir(os.path.join(folder, str(k)))
            with open(os.path.join(folder, str(k), "searches.txt"), "w") as f:
                f.writelines(" ".join("{" + ",".join(map(str, x)) + "}" for x in (s.order, s.lower, s.upper)) + "\n" for s in schemes.searches("kuch_k+2", k))
        own = schemes.read_scheme(folder)
    join = lambda x: ",".join(map(str, x))
    rows = [(k, i, join(s.order), join(s.lower), join(s.upper)) for k, found in own.searches.items() for i, s in enumerate(found)]
    return spark.createDataFrame(rows, "k int, search_no int, ord string, lo string, hi string")
