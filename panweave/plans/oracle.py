"""DuckDB SQL with the same meaning as the queries, from common table expressions."""

from __future__ import annotations

from panweave.functions.dna import AS_BASES, LETTERS


def dna(text: str) -> str:
    return f"translate(upper(regexp_replace({text}, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{AS_BASES}')"


def revcomp(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


def strains(k: int) -> str:
    return f"strains AS MATERIALIZED (SELECT strain, seq, len(seq) AS len FROM (SELECT doc_id AS strain, {dna('text')} AS seq FROM documents) WHERE len(seq) >= {k})"


def starts() -> str:
    return "starts AS (SELECT strain, len, CAST(coalesce(sum(len + 1) OVER (ORDER BY strain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM strains)"


def kmers(k: int, name: str = "kmers") -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT strain, pos, seq[pos + 1 : pos + {k}] AS gram,
    CASE WHEN pos > 0 THEN seq[pos : pos] WHEN strain = (SELECT min(strain) FROM strains) THEN '$' ELSE '%' END AS prev,
    CASE WHEN pos + {k} < len THEN seq[pos + {k} + 1 : pos + {k} + 1] ELSE '%' || strain END AS next
  FROM (SELECT strain, seq, len, unnest(range(len - {k} + 1)) AS pos FROM strains WHERE len >= {k}))"""


def graph(k: int) -> str:
    return f"{strains(k)}, {kmers(k)}, {graph_of(k)}"


def graph_of(k: int, kmers: str = "kmers") -> str:
    """The graph of strains whose k-mers are in the table ``kmers``."""
    return f"""flags AS MATERIALIZED (SELECT gram, count(DISTINCT next) > 1 AS rm, count(DISTINCT prev) > 1 AS lm FROM {kmers} GROUP BY gram),
marked AS (SELECT m.strain, m.pos, f.rm, coalesce(lead(f.lm) OVER (PARTITION BY m.strain ORDER BY m.pos), false) AS next_lm FROM {kmers} m JOIN flags f USING (gram)),
cuts AS (SELECT strain, pos AS cut, rm FROM marked WHERE rm OR next_lm),
closed AS (SELECT strain, row_number() OVER w - 1 AS seg_ord, coalesce(lag(cut) OVER w + 1, 0) AS seg_start, cut AS last_kmer_pos,
  CASE WHEN rm THEN 'right_maximal' ELSE 'pre_left_maximal' END AS kind FROM cuts WINDOW w AS (PARTITION BY strain ORDER BY cut)),
ends AS (SELECT s.strain, count(c.cut) AS seg_ord, coalesce(max(c.cut), -1) + 1 AS seg_start, any_value(s.len) - {k} + 1 AS last_kmer_pos, 'end' AS kind
  FROM strains s LEFT JOIN cuts c USING (strain) GROUP BY s.strain),
segs AS MATERIALIZED (SELECT a.strain, seg_ord, seg_start, last_kmer_pos, kind,
  seq[seg_start + 1 : last_kmer_pos + {k}] || CASE WHEN kind = 'end' THEN '%' ELSE '' END AS omega
  FROM (SELECT * FROM closed UNION ALL SELECT * FROM ends) a JOIN strains USING (strain)),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY kind_rank, last_kmer, strain) - 1 AS node_id FROM (
  SELECT CASE kind WHEN 'right_maximal' THEN 0 ELSE 1 END AS kind_rank, right(omega, {k}) AS last_kmer, -1 AS strain, kind, omega, count(*) AS multiplicity
  FROM segs WHERE kind <> 'end' GROUP BY kind, omega
  UNION ALL SELECT 2, '', strain, kind, omega, 1 FROM segs WHERE kind = 'end')),
nodes AS (SELECT CAST(node_id AS BIGINT) AS node_id, kind, omega, CAST(len(omega) AS BIGINT) AS len, CAST(multiplicity AS BIGINT) AS multiplicity FROM numbered),
node_occ AS MATERIALIZED (SELECT n.node_id, s.strain, s.seg_ord, s.seg_start, s.seg_start + len(s.omega) AS seg_end, s.last_kmer_pos, s.kind
  FROM segs s JOIN numbered n ON s.kind = n.kind AND s.omega = n.omega AND (s.kind <> 'end' OR s.strain = n.strain)),
steps AS (SELECT strain, node_id AS src, lead(node_id) OVER (PARTITION BY strain ORDER BY seg_ord) AS dst FROM node_occ),
edges AS MATERIALIZED (SELECT src, dst, strain, count(*) AS multiplicity FROM steps WHERE dst IS NOT NULL GROUP BY src, dst, strain)"""
