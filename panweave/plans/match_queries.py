"""Queries that match reads from ``benchmark`` with all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panweave.functions import dna as D
from panweave.operators import matching as M
from panweave.operators import paths as P
from panweave.operators import schemes
from panweave.operators import sequences as S
from panweave.plans import oracle as O
from panweave.plans.catalog import query
from panweave.plans.graph_queries import K, graph
from panweave.sources import tables as T

LENGTH, ERRORS, WORD, SCHEME = 100, 3, 12, "pigeon"


def _reads_sql(changed: bool) -> str:
    at = "CAST((read_id * 7) % len(seq) AS BIGINT)"
    change = f"left(seq, {at}) || translate(seq[{at} + 1 : {at} + 1], 'ACGT', 'CGTA') || seq[{at} + 2 : len(seq)]"
    return f"""reads AS MATERIALIZED (SELECT read_id, {change if changed else 'seq'} AS seq FROM (
  SELECT item_id * 1000000 + part AS read_id, CASE WHEN part + 1 < n THEN seq[part * {LENGTH} + 1 : part * {LENGTH} + {LENGTH}] ELSE seq[part * {LENGTH} + 1 : len(seq)] END AS seq
  FROM (SELECT *, unnest(range(n)) AS part FROM (SELECT item_id, seq, greatest(len(seq) // {LENGTH}, 1) AS n FROM (SELECT item_id, {O.dna('text')} AS seq FROM benchmark)))) WHERE seq <> ''),
ways AS MATERIALIZED (SELECT read_id, 0 AS rc, seq FROM reads UNION ALL SELECT read_id, 1, {O.revcomp('seq')} FROM reads)"""


def _near_sql(k: int, shift: bool) -> str:
    """Candidate begins by the k + 1 parts of a read, of which one is unchanged."""
    begin = "pos - o + s.d" if shift else "pos - o"
    shifts = f", (SELECT unnest(range(-{k}, {k} + 1)) AS d) s" if shift else ""
    return f"""words AS (SELECT strain, pos, gram FROM kmers),
seeds AS (SELECT read_id, rc, seq, o, seq[o + 1 : o + {WORD}] AS gram FROM (SELECT *, unnest(list_transform(range({k + 1}), lambda i: len(seq) * i // {k + 1})) AS o FROM ways)),
near AS MATERIALIZED (SELECT DISTINCT read_id, rc, w.seq, strain, {begin} AS begin FROM seeds w JOIN words USING (gram){shifts} WHERE {begin} >= 0)"""


_EXACT = f"""{O.strains(K)}, {O.starts()}, {O.kmers(WORD)}, {_reads_sql(False)}, {_near_sql(0, False)},
found AS MATERIALIZED (SELECT n.read_id, n.rc, n.strain, n.begin, len(n.seq) AS length, 0 AS ed FROM near n JOIN strains s USING (strain) WHERE s.seq[n.begin + 1 : n.begin + len(n.seq)] = n.seq)"""
_HAMMING = f"""{O.strains(K)}, {O.starts()}, {O.kmers(WORD)}, {_reads_sql(True)}, {_near_sql(ERRORS, False)},
texts AS (SELECT n.*, s.seq[n.begin + 1 : n.begin + len(n.seq)] AS matched FROM near n JOIN strains s USING (strain)),
found AS MATERIALIZED (SELECT read_id, rc, strain, begin, len(seq) AS length, hamming(matched, seq) AS ed, matched FROM texts WHERE len(matched) = len(seq) AND hamming(matched, seq) <= {ERRORS})"""
_EDIT = f"""{O.strains(K)}, {O.starts()}, {O.kmers(WORD)}, {_reads_sql(True)}, {_near_sql(ERRORS, True)},
texts AS (SELECT n.read_id, n.rc, n.seq, n.strain, n.begin, s.seq[n.begin + 1 : n.begin + n.l] AS matched, n.l FROM (SELECT *, unnest(range(len(seq) - {ERRORS}, len(seq) + {ERRORS} + 1)) AS l FROM near) n JOIN strains s USING (strain)),
found AS MATERIALIZED (SELECT read_id, rc, strain, begin, l AS length, levenshtein(matched, seq) AS ed, matched FROM texts WHERE len(matched) = l AND levenshtein(matched, seq) <= {ERRORS})"""
_BEST = """best AS MATERIALIZED (SELECT read_id, rc, strain, begin, b.length AS length, b.ed AS ed, b.matched AS matched FROM (
  SELECT read_id, rc, strain, begin, min({'ed': ed, 'length': length, 'matched': matched}) AS b FROM found GROUP BY read_id, rc, strain, begin))"""
_ITEM = "STRUCT(position BIGINT, ed BIGINT, length BIGINT, strain BIGINT, begin BIGINT)"
_FOLD = f"""{_BEST},
placed AS (SELECT read_id, rc, list(CAST({{'position': s.start + b.begin, 'ed': b.ed, 'length': b.length, 'strain': b.strain, 'begin': b.begin}} AS {_ITEM}) ORDER BY s.start + b.begin) AS items
  FROM best b JOIN starts s USING (strain) GROUP BY read_id, rc),
strings AS (SELECT read_id, rc, count(DISTINCT matched) AS n FROM found GROUP BY read_id, rc),
kept AS MATERIALIZED (SELECT read_id, rc, unnest(CASE WHEN n = 1 THEN items ELSE list_reduce(items, lambda acc, x:
  CASE WHEN len(acc) = 0 THEN [x] WHEN x.position - acc[len(acc)].position <= {2 * ERRORS} THEN
    CASE WHEN x.ed < acc[len(acc)].ed OR (x.ed = acc[len(acc)].ed AND x.length < acc[len(acc)].length) THEN list_append(acc[1 : len(acc) - 1], x) ELSE acc END
  ELSE list_append(acc, x) END, CAST([] AS {_ITEM}[])) END) AS x FROM placed JOIN strings USING (read_id, rc)),
mapped AS MATERIALIZED (SELECT read_id, rc, x.strain AS strain, x.begin AS begin, x.position AS position, x.length AS length, x.ed AS ed FROM kept)"""


def _paths_sql(table: str) -> str:
    return f"""paths AS MATERIALIZED (SELECT f.read_id, f.rc, f.strain, f.begin, f.length, f.ed, string_agg(o.node_id, ',' ORDER BY o.seg_ord) AS path,
  list(o.node_id ORDER BY o.seg_ord) AS nodes, f.begin - min(o.seg_start) AS dist_left
  FROM {table} f JOIN node_occ o ON o.strain = f.strain AND o.seg_start <= f.begin + f.length - {K} AND o.last_kmer_pos >= f.begin
  WHERE f.length >= {K} GROUP BY f.read_id, f.rc, f.strain, f.begin, f.length, f.ed)"""


_GRAPH = f"{O.kmers(K, 'graph_kmers')}, {O.graph_of(K, 'graph_kmers')}"
_INTS = "read_id, CAST(rc AS INTEGER) AS rc, strain, CAST(begin AS BIGINT) AS begin, CAST(length AS INTEGER) AS length, CAST(ed AS INTEGER) AS ed"


def _both(spark: SparkSession, sf_dir: str, changed: bool = True) -> DataFrame:
    return S.both_ways((T.changed_reads if changed else T.reads)(spark, sf_dir, LENGTH))


def _starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_starts(T.strains(spark, sf_dir, K)).select("strain", "start", "len")


def _edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.edit_occurrences(_both(spark, sf_dir), T.strains(spark, sf_dir, K), ERRORS, SCHEME)


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.dedup_positions(_edit(spark, sf_dir), _starts(spark, sf_dir), ERRORS)


def _mapped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mapped(spark, sf_dir)
    return P.node_paths(found.withColumn("length", F.col("length")), graph(spark, sf_dir))


COLUMNS = ["read_id", "rc", "strain", "begin", "length", "ed"]


@query(f"WITH {_EXACT} SELECT {_INTS}, CAST(start + begin AS BIGINT) AS position FROM found JOIN starts USING (strain)")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.exact_occurrences(_both(spark, sf_dir, False), T.strains(spark, sf_dir, K))
    return found.join(_starts(spark, sf_dir), "strain").select(*COLUMNS, (F.col("start") + F.col("begin")).alias("position"))


@query(f"WITH {_EXACT}, {_GRAPH}, {_paths_sql('found')} SELECT {_INTS}, path, CAST(dist_left AS BIGINT) AS dist_left FROM paths")
def exact_match_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.exact_occurrences(_both(spark, sf_dir, False), T.strains(spark, sf_dir, K)).select(*COLUMNS)
    return P.node_paths(found, graph(spark, sf_dir)).select(*COLUMNS, P.path_string(F.col("path"), F.col("length"), K).alias("path"), "dist_left")


@query(f"WITH {_HAMMING} SELECT {_INTS} FROM found")
def hamming_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hamming_occurrences(_both(spark, sf_dir), T.strains(spark, sf_dir, K), ERRORS, SCHEME).select(*COLUMNS)


@query(f"WITH {_EDIT} SELECT {_INTS} FROM found")
def edit_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edit(spark, sf_dir).select(*COLUMNS)


@query(f"WITH {_EDIT} SELECT {_INTS} FROM found")
def edit_match_default_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches by the default search scheme with static parts."""
    return M.edit_occurrences(_both(spark, sf_dir), T.strains(spark, sf_dir, K), ERRORS, schemes.DEFAULT, partition="static").select(*COLUMNS)


@query(f"WITH {_EDIT}, {_BEST} SELECT {_INTS} FROM best")
def best_per_begin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_per_begin(_edit(spark, sf_dir)).select(*COLUMNS)


@query(f"WITH {_EDIT}, {_FOLD} SELECT {_INTS}, CAST(position AS BIGINT) AS position FROM mapped")
def dedup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select(*COLUMNS, "position")


@query(f"""WITH {_EDIT}, {_FOLD} SELECT CAST(read_id AS VARCHAR) AS identifier, CAST(position AS BIGINT) AS position, CAST(length AS INTEGER) AS length, CAST(ed AS INTEGER) AS "ED", CAST(rc AS INTEGER) AS "reverseComplement" FROM mapped""")
def map_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir).select(F.col("read_id").cast("string").alias("identifier"), "position", "length", F.col("ed").alias("ED"), F.col("rc").alias("reverseComplement"))


_MAPPED_PATHS = f"{_EDIT}, {_FOLD}, {_GRAPH}, {_paths_sql('mapped')}"


@query(f"""WITH {_MAPPED_PATHS} SELECT CAST(p.read_id AS VARCHAR) AS "Identifier", CAST(dense_rank() OVER (PARTITION BY p.read_id ORDER BY p.rc, p.nodes) - 1 AS INTEGER) AS "SubgraphID", p.path AS "Path",
  CAST(p.dist_left AS BIGINT) AS "DistanceFromLeftEnd", p.strain AS "Strain", CAST(s.start + p.begin AS BIGINT) AS "Position", CAST(p.length AS INTEGER) AS "Length", CAST(p.ed AS INTEGER) AS "ED", CAST(p.rc AS INTEGER) AS "reverseComplement"
  FROM paths p JOIN starts s USING (strain)""")
def map_strain_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.subgraph_ids(_mapped_paths(spark, sf_dir))
    return found.select(
        F.col("read_id").cast("string").alias("Identifier"), F.col("subgraph_id").alias("SubgraphID"), P.path_string(F.col("path"), F.col("length"), K).alias("Path"),
        F.col("dist_left").alias("DistanceFromLeftEnd"), F.col("strain").alias("Strain"), F.col("position").alias("Position"), F.col("length").alias("Length"),
        F.col("ed").alias("ED"), F.col("rc").alias("reverseComplement"),
    )


@query(f"WITH {_MAPPED_PATHS} SELECT read_id, CAST(rc AS INTEGER) AS rc, path, count(*) AS n_matches, CAST(min(ed) AS INTEGER) AS least_ed FROM paths GROUP BY read_id, rc, path")
def matches_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mapped_paths(spark, sf_dir).groupBy("read_id", "rc", "path").agg(F.count("*").alias("n_matches"), F.min("ed").alias("least_ed"))
    return found.withColumn("path", P.path_string(F.col("path"), F.lit(K), K))


@query(f"""WITH {_MAPPED_PATHS},
m AS (SELECT read_id, count(*) AS n FROM mapped GROUP BY read_id), w AS (SELECT read_id, count(DISTINCT rc || ':' || path) AS p FROM paths GROUP BY read_id),
e AS (SELECT r.read_id, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM (SELECT DISTINCT read_id FROM reads) r LEFT JOIN m USING (read_id) LEFT JOIN w USING (read_id))
SELECT count(*) AS n_reads, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_mapped, CAST(sum(n) AS BIGINT) AS n_matches, CAST(sum(p) AS BIGINT) AS n_paths,
  CAST(sum(n) AS DOUBLE) / count(*) AS mean_matches, CAST(sum(p) AS DOUBLE) / count(*) AS mean_paths, CAST(median(n) AS DOUBLE) AS median_matches FROM e""")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mapped_paths(spark, sf_dir)
    return M.report(T.changed_reads(spark, sf_dir, LENGTH), found, found)


@query(f"WITH {_EDIT} SELECT read_id, seq FROM reads WHERE read_id IN (SELECT read_id FROM found)")
def reads_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.changed_reads(spark, sf_dir, LENGTH).join(_edit(spark, sf_dir).select("read_id"), "read_id", "left_semi")


@query(f"WITH {_EDIT} SELECT read_id, seq FROM reads WHERE read_id NOT IN (SELECT read_id FROM found)")
def reads_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.changed_reads(spark, sf_dir, LENGTH).join(_edit(spark, sf_dir).select("read_id"), "read_id", "left_anti")


@query(f"WITH {_EDIT} SELECT read_id, CAST(rc AS INTEGER) AS rc, strain, CAST(begin AS BIGINT) AS begin FROM (SELECT DISTINCT read_id, rc, strain, pos - o AS begin FROM seeds JOIN words USING (gram))")
def seed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, strains = _both(spark, sf_dir), T.strains(spark, sf_dir, K)
    hits = M.seeds(reads, ERRORS, SCHEME).withColumn("word", F.substring("word", 1, WORD)).join(S.windows(strains, WORD).withColumnRenamed("gram", "word"), "word")
    return hits.select("read_id", "rc", "strain", (F.col("pos") - F.col("offset")).alias("begin")).distinct()


@query(f"WITH {_EDIT}, {_FOLD} SELECT (SELECT count(*) FROM (SELECT DISTINCT read_id, rc, strain, pos - o AS begin FROM seeds JOIN words USING (gram))) AS n_candidates, (SELECT count(*) FROM (SELECT DISTINCT read_id, rc, strain, begin FROM near)) AS n_places, (SELECT count(*) FROM found) AS n_verified, (SELECT count(*) FROM (SELECT DISTINCT read_id, rc, strain, begin FROM found)) AS n_begins, (SELECT count(*) FROM mapped) AS n_kept")
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work and matches of each step of the mapping: candidates by seeds, places looked at, matches, begins, matches kept."""
    from panweave.operators.ranking import cut

    near = cut(seed_candidates(spark, sf_dir))
    places = near.select("read_id", "rc", "strain", F.explode(F.sequence(F.col("begin") - ERRORS, F.col("begin") + ERRORS)).alias("begin")).filter("begin >= 0").distinct()
    work = near.agg(F.count("*").alias("n_candidates")).crossJoin(places.agg(F.count("*").alias("n_places")))  # one row each
    found = cut(_edit(spark, sf_dir))
    kept = M.dedup_positions(found, _starts(spark, sf_dir), ERRORS).agg(F.count("*").alias("n_kept"))
    return found.agg(F.count("*").alias("n_verified"), F.count_distinct("read_id", "rc", "strain", "begin").alias("n_begins")).crossJoin(kept).crossJoin(work)  # one row each


_NAMES = f"names AS (SELECT n_nationkey AS read_id, {O.dna('n_name')} AS seq FROM nation)"
_PASSAGES = f"passages AS (SELECT item_id AS strain, {O.dna('text')} AS seq FROM benchmark)"


@query(f"""WITH {_NAMES}, {_PASSAGES}, places AS (SELECT r.read_id, r.seq, p.strain, p.seq AS text, unnest(range(len(p.seq))) AS begin FROM names r, passages p WHERE len(p.seq) > 0),
texts AS (SELECT *, text[begin + 1 : begin + l] AS matched FROM (SELECT *, unnest(range(greatest(len(seq) - 1, 1), len(seq) + 2)) AS l FROM places))
SELECT CAST(read_id AS BIGINT) AS read_id, 0 AS rc, strain, begin, CAST(l AS INTEGER) AS length, CAST(levenshtein(matched, seq) AS INTEGER) AS ed FROM texts WHERE len(matched) = l AND levenshtein(matched, seq) <= 1""")
def edit_match_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names, too short for seeds, against all passages with one error."""
    reads = T.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("read_id"), F.lit(0).alias("rc"), S.dna(F.col("n_name")).alias("seq"))
    passages = S.strains_of(T.table(spark, sf_dir, "benchmark"), 1, id_column="item_id")
    return M.naive_edit_occurrences(reads, passages, 1).select(*COLUMNS)


_SHORT = "words AS (SELECT DISTINCT dense_rank() OVER (ORDER BY seq) AS read_id, seq FROM (SELECT seq[1 : n] AS seq FROM names, (SELECT unnest([3, 5, 9]) AS n)))"


@query(f"""WITH {_NAMES}, {_PASSAGES}, {_SHORT}, places AS (SELECT r.read_id, r.seq, p.strain, p.seq AS text, unnest(range(len(p.seq))) AS begin FROM words r, passages p WHERE len(p.seq) > 0),
texts AS (SELECT *, text[begin + 1 : begin + l] AS matched FROM (SELECT *, unnest(range(greatest(len(seq) - 2, 1), len(seq) + 3)) AS l FROM places))
SELECT CAST(read_id AS BIGINT) AS read_id, 0 AS rc, strain, begin, CAST(l AS INTEGER) AS length, CAST(levenshtein(matched, seq) AS INTEGER) AS ed FROM texts WHERE len(matched) = l AND levenshtein(matched, seq) <= 2""")
def short_read_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of up to nine bases, some with fewer bases than the scheme has parts, by the mapper for all reads."""
    names = T.table(spark, sf_dir, "nation").select(S.dna(F.col("n_name")).alias("name"))
    words = names.select(F.explode(F.array(*(F.substring("name", 1, n) for n in (3, 5, 9)))).alias("seq")).distinct()
    from pyspark.sql.window import Window

    reads = words.select(F.dense_rank().over(Window.orderBy("seq")).cast("long").alias("read_id"), F.lit(0).alias("rc"), "seq")  # a row for each nation and length
    passages = S.strains_of(T.table(spark, sf_dir, "benchmark"), 1, id_column="item_id")
    return M.occurrences(reads, passages, 2, "edit", "01star0").select(*COLUMNS)


@query(f"""WITH {O.strains(K)}, {O.starts()} SELECT c.position, s.strain, c.position - s.start AS begin FROM (SELECT c_custkey * 1009 AS position FROM customer) c
  LEFT JOIN starts s ON c.position >= s.start AND c.position < s.start + s.len""")
def strain_of_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = T.table(spark, sf_dir, "customer").select((F.col("c_custkey") * 1009).cast("long").alias("position"))
    return P.strain_of(positions, _starts(spark, sf_dir))


@query(f"""WITH {O.graph(K)}, names AS (SELECT DISTINCT {O.dna('n_name')} AS word FROM nation)
SELECT word, string_agg(node_id, '/' ORDER BY node_id) AS nodes FROM names, nodes WHERE len(word) BETWEEN 1 AND {K - 1} AND contains(omega, word) GROUP BY word""")
def nodes_under_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.table(spark, sf_dir, "nation").select(S.dna(F.col("n_name")).alias("word"))
    return P.nodes_under_k_text(words, graph(spark, sf_dir))


@query(f"SELECT read_id, seq FROM (WITH {_reads_sql(False)} SELECT * FROM reads) WHERE NOT (read_id % 3 = 0 OR read_id % 10 = 7)")
def reads_without_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of reads of which some got an N, at the begin or within, those without."""
    reads, at = T.reads(spark, sf_dir, LENGTH), F.when(F.col("read_id") % 3 == 0, 0).when(F.col("read_id") % 10 == 7, F.length("seq") - 1)
    spoilt = reads.withColumn("seq", F.when(at.isNull(), F.col("seq")).otherwise(F.concat(F.substring(F.col("seq"), F.lit(1), at), F.lit("N"), F.expr("substring(seq, 2)"))))
    return S.without_n(spoilt)


@query(f"""WITH {O.strains(K)}, {O.kmers(WORD)} SELECT DISTINCT gram AS kmer, gram[2 : {WORD}] || 'G' AS pushed_right, 'T' || gram[1 : {WORD - 1}] AS pushed_left, gram[3 : 3] AS third FROM kmers""")
def kmer_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct k-mers by their codes, moved by one base to either side."""
    codes = S.windows(T.strains(spark, sf_dir, K), WORD).select(D.kmer_code(F.col("gram")).alias("code")).distinct()
    text = lambda code: D.kmer_text(code, WORD)
    code = F.col("code")
    return codes.select(text(code).alias("kmer"), text(D.push_right(code, F.lit("G"), WORD)).alias("pushed_right"), text(D.push_left(code, F.lit("T"), WORD)).alias("pushed_left"), D.peek(code, 2, WORD).alias("third"))


@query()
def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the best match of each begin is made of its read."""
    return M.with_cigars(M.best_per_begin(_edit(spark, sf_dir)), _both(spark, sf_dir)).select(*COLUMNS, "cigar")
