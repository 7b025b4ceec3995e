"""Queries over sequences and the neighbour network."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS
from ..functions.hashing import seeded_hash
from ..operators import communities, network, sequences
from .inputs import PEPTIDES_SQL, SCORED_SQL, WORDS_SQL, hash_sql, peptides, scored_peptides, table, word_rows
from ..session import stage, widen
from .registry import query, r, rnd, rounded

_AA_LIST = "[" + ", ".join(f"'{a}'" for a in AMINO_ACIDS) + "]"


@query(
    "sequence_filter",
    f"""WITH {WORDS_SQL}
SELECT doc_id, word AS peptide FROM w WHERE regexp_full_match(word, '[{AMINO_ACIDS}]{{8,11}}')""",
)
def q_sequence_filter(spark, sf_dir):
    rows = word_rows(spark, sf_dir).select("doc_id", F.col("word").alias("peptide"))
    return sequences.sequence_filter(rows)


@query(
    "sliding_window",
    f"""WITH {PEPTIDES_SQL}
SELECT peptide, CAST(i AS INTEGER) AS start, substr(peptide, i, 3) AS "window"
FROM (SELECT peptide, unnest(range(1, length(peptide) - 1)) AS i FROM pep)""",
)
def q_sliding_window(spark, sf_dir):
    return sequences.sliding_window(peptides(spark, sf_dir), width=3)


@query(
    "insilico_mutagenesis",
    f"""WITH {PEPTIDES_SQL},
p AS (SELECT peptide AS s, unnest(range(1, length(peptide) + 1)) AS i FROM pep),
pa AS (SELECT s, i, unnest({_AA_LIST}) AS a FROM p),
m AS (
  SELECT peptide AS s FROM pep
  UNION SELECT substr(s, 1, i - 1) || a || substr(s, i + 1) FROM pa
  UNION SELECT substr(s, 1, i - 1) || a || substr(s, i) FROM pa
  UNION SELECT substr(s, 1, i - 1) || substr(s, i + 1) FROM p)
SELECT CAST(length(s) AS INTEGER) AS "length", substr(s, 1, 1) AS first_residue, count(*) AS n_mutants,
  CAST(sum({hash_sql("'0'", 's')}) AS BIGINT) AS digest
FROM m WHERE length(s) BETWEEN 8 AND 11 GROUP BY 1, 2""",
)
def q_insilico_mutagenesis(spark, sf_dir):
    """All mutants of all peptides, reported as a count and an order-free hash sum per length and first residue."""
    mutants = sequences.insilico_mutagenesis(peptides(spark, sf_dir))
    return mutants.groupBy(
        F.length("peptide").alias("length"), F.substring("peptide", 1, 1).alias("first_residue")
    ).agg(F.count("*").alias("n_mutants"), F.sum(seeded_hash(0, F.col("peptide"))).alias("digest"))


@query(
    "peptide_basic",
    f"""WITH {PEPTIDES_SQL}
SELECT peptide, CAST(length(peptide) AS INTEGER) AS Peptide_Length,
{", ".join(f"CAST(contains(peptide, '{a}') AS DOUBLE) AS Peptide_Contain{a}" for a in AMINO_ACIDS)}
FROM pep""",
)
def q_peptide_basic(spark, sf_dir):
    return sequences.peptide_basic(peptides(spark, sf_dir))


PAIRS_SQL = f"""sub AS (
  SELECT peptide AS s, i, substr(peptide, i, 1) AS a, substr(peptide, 1, i - 1) || '_' || substr(peptide, i + 1) AS k
  FROM (SELECT peptide, unnest(range(1, length(peptide) + 1)) AS i FROM pep)),
del AS (
  SELECT x.s AS longer, y.peptide AS shorter, min(x.i) AS i, min_by(x.a, x.i) AS a
  FROM sub x JOIN pep y ON y.peptide = replace(x.k, '_', '') GROUP BY 1, 2),
pairs AS (
  SELECT x.s AS aaseq1, y.s AS aaseq2, 'Substitution' AS mut_pattern, x.a || '_' || x.i || '_' || y.a AS mut_type
  FROM sub x JOIN sub y ON x.k = y.k AND x.i = y.i AND x.a <> y.a
  UNION ALL SELECT longer, shorter, 'Deletion', a || '_' || i || '_-' FROM del
  UNION ALL SELECT shorter, longer, 'Insertion', '-_' || i || '_' || a FROM del WHERE i < length(longer))"""

WEIGHTED_SQL = PAIRS_SQL + """,
dw AS (
  SELECT p.*, a.score AS score1, b.score AS score2, b.score / a.score AS score_ratio,
         greatest(a.score / b.score, 0.001) AS edge_weight
  FROM pairs p JOIN pep a ON a.peptide = p.aaseq1 JOIN pep b ON b.peptide = p.aaseq2
  WHERE b.score >= a.score)"""


@query("neighbor_pairs", f"WITH {PEPTIDES_SQL}, {PAIRS_SQL} SELECT * FROM pairs")
def q_neighbor_pairs(spark, sf_dir):
    return network.neighbor_pairs(widen(stage(peptides(spark, sf_dir))))


def scored_network(spark, sf_dir):
    """Scored peptides, written once because the network reads them five times, and their directed edges."""
    scored = widen(stage(scored_peptides(spark, sf_dir)))
    return scored, network.neighbor_weighted(network.neighbor_pairs(scored.select("peptide")), scored)


def weighted_edges(spark, sf_dir):
    return scored_network(spark, sf_dir)[1]


@query(
    "neighbor_weighted",
    f"""WITH {SCORED_SQL}, {WEIGHTED_SQL}
SELECT aaseq1, aaseq2, mut_pattern, mut_type, score1, score2, {r('score_ratio', 'score_ratio', 9)},
       {r('edge_weight', 'edge_weight', 9)} FROM dw""",
)
def q_neighbor_weighted(spark, sf_dir):
    return rounded(weighted_edges(spark, sf_dir), ["score_ratio", "edge_weight"], 9)


@query(
    "ego_pairs",
    f"""WITH {SCORED_SQL}, {WEIGHTED_SQL},
t AS (SELECT aaseq1 AS target, true AS outgoing, score_ratio AS sr, * FROM dw
      UNION ALL SELECT aaseq2, false, 1 / score_ratio, * FROM dw)
SELECT target, outgoing, aaseq1, aaseq2, mut_pattern, score1, score2, {r('sr', 'score_ratio', 9)},
       {r('edge_weight', 'edge_weight', 9)}, split_part(mut_type, '_', 1) AS aa1,
       CAST(split_part(mut_type, '_', 2) AS INTEGER) AS pos, split_part(mut_type, '_', 3) AS aa2
FROM t""",
)
def q_ego_pairs(spark, sf_dir):
    return rounded(network.ego_pairs(weighted_edges(spark, sf_dir)), ["score_ratio", "edge_weight"], 9)


EGO_SQL = """mem AS (
  SELECT DISTINCT target, node FROM (
    SELECT aaseq1 AS target, aaseq2 AS node FROM dw UNION ALL SELECT aaseq2, aaseq1 FROM dw
    UNION ALL SELECT aaseq1, aaseq1 FROM dw UNION ALL SELECT aaseq2, aaseq2 FROM dw)),
ego AS (
  SELECT a.target, d.* FROM dw d JOIN mem a ON a.node = d.aaseq1
  JOIN mem b ON b.node = d.aaseq2 AND b.target = a.target)"""


@query(
    "ego_edges",
    f"""WITH {SCORED_SQL}, {WEIGHTED_SQL}, {EGO_SQL}
SELECT target, aaseq1, aaseq2, mut_pattern, mut_type FROM ego""",
)
def q_ego_edges(spark, sf_dir):
    edges = weighted_edges(spark, sf_dir).select("aaseq1", "aaseq2", "mut_pattern", "mut_type")
    return network.ego_edges(stage(edges))


@query(
    "top_escape_edges",
    f"""WITH {SCORED_SQL}, {WEIGHTED_SQL}
SELECT aaseq1, aaseq2, mut_type, score1, score2, {r('score_ratio', 'score_ratio', 9)} FROM dw
ORDER BY score_ratio DESC, score2 DESC, aaseq1, aaseq2, mut_type LIMIT 100""",
)
def q_top_escape_edges(spark, sf_dir):
    """Flagship: scan, tokenise, filter, neighbour search, scoring and a top-100 report."""
    edges = weighted_edges(spark, sf_dir)
    top = edges.orderBy(
        F.desc("score_ratio"), F.desc("score2"), F.asc("aaseq1"), F.asc("aaseq2"), F.asc("mut_type")
    ).limit(100)
    return rounded(top.select("aaseq1", "aaseq2", "mut_type", "score1", "score2", "score_ratio"), ["score_ratio"], 9)


# --- communities ------------------------------------------------------------------------------------------


@query("ego_clusters")
def q_ego_clusters(spark, sf_dir):
    scored, edges = scored_network(spark, sf_dir)
    return communities.ego_clusters(stage(edges), scored)


@query("escape_potential_walk")
def q_escape_potential_walk(spark, sf_dir):
    scored, edges = scored_network(spark, sf_dir)
    return communities.escape_potential(communities.ego_clusters(stage(edges), scored), "score")


# A clustering both engines can state: ego members grouped by length.
SUMMARY_SQL = """summary AS (
  SELECT target, node AS peptide, CASE WHEN target = node THEN 'Target' ELSE 'Neighbor' END AS role,
         'Cluster' || length(node) AS cluster_id, score FROM mem JOIN pep ON pep.peptide = mem.node),
clu AS (SELECT target, cluster_id, avg(score) AS a, max(score) AS mx, min(score) AS mn, bool_or(role = 'Target') AS own,
          max(score) FILTER (role = 'Target') AS s FROM summary GROUP BY 1, 2),
esc AS (SELECT target AS peptide, max(cluster_id) FILTER (own) AS cluster_id, max(s) AS score,
          max(a) FILTER (own) AS ca,
          coalesce(max(a) FILTER (NOT own), '-inf'::DOUBLE) - max(a) FILTER (own) AS dmax,
          max(a) FILTER (own) - coalesce(min(a) FILTER (NOT own), 'inf'::DOUBLE) AS dmin,
          max(mx) - max(s) AS pmax, max(s) - min(mn) AS pmin FROM clu GROUP BY 1)"""


def _length_clusters(spark, sf_dir):
    scored, edges = scored_network(spark, sf_dir)
    members = network.ego_members(edges)
    return members.withColumnRenamed("node", "peptide").join(scored, "peptide").select(
        "target",
        "peptide",
        F.when(F.col("target") == F.col("peptide"), "Target").otherwise("Neighbor").alias("role"),
        F.concat(F.lit("Cluster"), F.length("peptide").cast("string")).alias("cluster_id"),
        "score",
    )


@query(
    "escape_potential",
    f"""WITH {SCORED_SQL}, {WEIGHTED_SQL}, {EGO_SQL}, {SUMMARY_SQL}
SELECT peptide, cluster_id, score AS immunogenicity_score, {rnd('ca', 9)} AS cluster_average,
  {rnd('dmax', 9)} AS cluster_diff_max, {rnd('dmin', 9)} AS cluster_diff_min, pmax AS diff_max, pmin AS diff_min FROM esc""",
)
def q_escape_potential(spark, sf_dir):
    out = communities.escape_potential(_length_clusters(spark, sf_dir), "score")
    return rounded(out, ["cluster_average", "cluster_diff_max", "cluster_diff_min"], 9)


@query(
    "prioritize",
    f"""WITH {SCORED_SQL}, {WEIGHTED_SQL}, {EGO_SQL}, {SUMMARY_SQL},
orig AS (SELECT DISTINCT upper(token) AS peptide
         FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM benchmark))
SELECT peptide, score AS immunogenicity_score, {rnd('ca', 9)} AS immunogenicity_score_cluster_average,
  {rnd('dmin', 9)} AS escape_potential FROM esc WHERE peptide IN (SELECT peptide FROM orig)
ORDER BY score DESC, ca DESC, dmin, peptide""",
)
def q_prioritize(spark, sf_dir):
    scores = scored_peptides(spark, sf_dir).withColumnRenamed("score", "immunogenicity_score")
    measured = communities.escape_potential(_length_clusters(spark, sf_dir), "score")
    originals = sequences.words(table(spark, sf_dir, "benchmark")).select(F.col("word").alias("peptide"))
    out = communities.prioritize(scores, measured, originals)
    return rounded(out, ["immunogenicity_score_cluster_average", "escape_potential"], 9)


@query(
    "cluster_consensus",
    f"""WITH {PEPTIDES_SQL},
m AS (SELECT peptide, length(peptide) || '-' || substr(peptide, 1, 2) AS cluster_id FROM pep),
sz AS (SELECT cluster_id, count(*) AS size FROM m GROUP BY 1),
l AS (SELECT cluster_id, i, substr(peptide, i, 1) AS a, count(*) AS n
      FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS i FROM m) GROUP BY 1, 2, 3),
s AS (SELECT cluster_id, i, size, CASE WHEN count(*) FILTER (n * 2 >= size) = 1 THEN max(a) FILTER (n * 2 >= size)
      ELSE 'X' END AS symbol FROM l JOIN sz USING (cluster_id) GROUP BY 1, 2, 3)
SELECT cluster_id, size, string_agg(symbol, '' ORDER BY i) AS consensus FROM s GROUP BY 1, 2""",
)
def q_cluster_consensus(spark, sf_dir):
    members = peptides(spark, sf_dir).withColumn(
        "cluster_id", F.concat_ws("-", F.length("peptide").cast("string"), F.substring("peptide", 1, 2))
    )
    return communities.cluster_consensus(members)


@query(
    "consensus_indel",
    f"""WITH {PEPTIDES_SQL}, {PAIRS_SQL},
m AS (SELECT DISTINCT * FROM (SELECT aaseq1 AS target, aaseq2 AS peptide FROM pairs UNION ALL SELECT aaseq2, aaseq1 FROM pairs
  UNION ALL SELECT aaseq1, aaseq1 FROM pairs UNION ALL SELECT aaseq2, aaseq2 FROM pairs)),
a AS (SELECT *, length(peptide) - length(target) AS more, coalesce(list_min([i FOR i IN range(1, least(length(peptide), length(target)) + 1)
  IF peptide[i] <> target[i]]) - 1, least(length(peptide), length(target))) AS agreed FROM m),
l AS (SELECT target, CASE WHEN more = 1 AND i = agreed + 1 THEN 2 * i - 1 WHEN more = 1 AND i > agreed THEN 2 * i - 2
  WHEN more = -1 AND i > agreed THEN 2 * i + 2 ELSE 2 * i END AS col, peptide[i] AS residue
  FROM (SELECT *, unnest(range(1, length(peptide) + 1)) AS i FROM a)),
z AS (SELECT target, count(*) AS size FROM m GROUP BY 1),
c AS (SELECT target, col, residue, count(*) AS n FROM l GROUP BY 1, 2, 3),
h AS (SELECT target, col, size, sum(n) AS present, count(*) FILTER (2 * n >= size) AS many, max(residue) FILTER (2 * n >= size) AS residue
  FROM c JOIN z USING (target) GROUP BY 1, 2, 3)
SELECT target, size, string_agg(CASE WHEN many = 1 AND 2 * (size - present) < size THEN residue ELSE 'X' END, '' ORDER BY col) AS consensus
FROM h GROUP BY 1, 2""",
)
def q_consensus_indel(spark, sf_dir):
    """Consensus of every peptide's neighbourhood: all that is one edit away, insertions and deletions among them."""
    pairs = stage(network.neighbor_pairs(widen(stage(peptides(spark, sf_dir)))).select("aaseq1", "aaseq2"))
    both = pairs.select(F.col("aaseq1").alias("target"), F.col("aaseq2").alias("peptide")).union(pairs.select("aaseq2", "aaseq1"))
    members = both.union(both.select("target", "target")).distinct()
    return communities.aligned_consensus(members)
