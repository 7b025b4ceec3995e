"""Queries over fragment libraries, contact profiling and distribution statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS
from ..functions.distribution import distribution_stats
from ..functions.names import CPP_STATS
from ..operators import contact_profile, fragments
from ..session import stage
from ..sources import contact_scales
from .inputs import PEPTIDES_SQL, RECEPTORS_SQL, WORDS_SQL, hash_sql, peptides, receptors, table, word_rows
from .registry import query, r, rounded

LENS, SEEDS, DEPTH = (3, 4, 5, 6, 7, 8), (1, 2), 1000
CPP_LENS, CPP_DEPTH, CPP_LIBRARY_DEPTH = (3, 4), 100, 300


def fragments_sql(lens) -> str:
    return f"""frag AS (
  SELECT l AS frag_len, unnest([substr(cdr3b, i, l) FOR i IN range(1, length(cdr3b) - l + 2)]) AS f
  FROM tcr, (SELECT unnest({list(lens)}) AS l)),
both_ways AS (SELECT frag_len, f FROM frag UNION ALL SELECT frag_len, reverse(f) FROM frag),
freq AS (
  SELECT CAST(frag_len AS INTEGER) AS frag_len, f AS fragment, count(*) AS "count",
         count(*) / sum(count(*)) OVER (PARTITION BY frag_len) AS freq
  FROM both_ways GROUP BY frag_len, f)"""


def draws_sql(lens, seeds, depth) -> str:
    return f"""draw AS (
  SELECT CAST(l AS INTEGER) AS frag_len, CAST(s AS INTEGER) AS seed, id
  FROM (SELECT unnest({list(lens)}) AS l), (SELECT unnest({list(seeds)}) AS s),
       (SELECT unnest(range(1, {depth + 1})) AS id))"""


def _u(kind: str) -> str:
    return hash_sql("CAST(seed AS VARCHAR)", f"'{kind}'", "CAST(draw.frag_len AS VARCHAR)", "CAST(id AS VARCHAR)")


DEDUP_SQL = f"""ranked AS (
  SELECT frag_len, fragment, count(*) OVER (PARTITION BY frag_len) AS size,
         row_number() OVER (PARTITION BY frag_len ORDER BY {hash_sql("'Deduplicated'", 'fragment')}, fragment) AS rank
  FROM freq),
dedup AS (
  SELECT 'Deduplicated' AS library, draw.frag_len, seed, id, fragment
  FROM draw JOIN (SELECT frag_len, max(size) AS size FROM ranked GROUP BY 1) z USING (frag_len)
  JOIN ranked x ON x.frag_len = draw.frag_len
   AND x.rank = CAST(floor({_u('Deduplicated')} / 4294967296.0::DOUBLE * z.size) AS BIGINT) + 1)"""

WEIGHTED_SQL = f"""cdf AS (
  SELECT frag_len, fragment, sum("count") OVER (PARTITION BY frag_len ORDER BY fragment) AS hi, "count",
         sum("count") OVER (PARTITION BY frag_len) AS total FROM freq),
drawn AS (
  SELECT draw.*, CAST(floor({_u('Weighted')} / 4294967296.0::DOUBLE * t.total) AS BIGINT) AS pos
  FROM draw JOIN (SELECT frag_len, max(total)::BIGINT AS total FROM cdf GROUP BY 1) t USING (frag_len)),
weighted AS (
  SELECT 'Weighted' AS library, drawn.frag_len, seed, id, fragment
  FROM drawn JOIN cdf ON cdf.frag_len = drawn.frag_len AND drawn.pos < cdf.hi AND drawn.pos >= cdf.hi - cdf."count")"""


@query(
    "fragment_freq",
    f'WITH {RECEPTORS_SQL}, {fragments_sql(LENS)} SELECT frag_len, fragment, "count", {r("freq", "freq", 12)} FROM freq',
)
def q_fragment_freq(spark, sf_dir):
    return rounded(fragments.fragment_freq(receptors(spark, sf_dir), "cdr3b", LENS), ["freq"], 12)


@query(
    "frag_dedup",
    f"WITH {RECEPTORS_SQL}, {fragments_sql(LENS)}, {draws_sql(LENS, SEEDS, DEPTH)}, {DEDUP_SQL} SELECT * FROM dedup",
)
def q_frag_dedup(spark, sf_dir):
    freq = stage(fragments.fragment_freq(receptors(spark, sf_dir), "cdr3b", LENS))
    return fragments.sample_deduplicated(freq, LENS, SEEDS, DEPTH)


@query(
    "frag_weighted",
    f"""WITH {RECEPTORS_SQL}, {fragments_sql(LENS)}, {draws_sql(LENS, SEEDS, DEPTH)}, {WEIGHTED_SQL}
SELECT * FROM weighted""",
)
def q_frag_weighted(spark, sf_dir):
    freq = stage(fragments.fragment_freq(receptors(spark, sf_dir), "cdr3b", LENS))
    return fragments.sample_weighted(freq, LENS, SEEDS, DEPTH)


MOCK_DEPTH_SQL = "SELECT count(*) FROM documents"


@query(
    "frag_mock",
    f"""WITH draw AS (
  SELECT CAST(l AS INTEGER) AS frag_len, CAST(s AS INTEGER) AS seed, id
  FROM (SELECT unnest({list(LENS)}) AS l), (SELECT unnest({list(SEEDS)}) AS s),
       (SELECT unnest(range(1, ({MOCK_DEPTH_SQL}) + 1)) AS id))
SELECT 'Mock' AS library, frag_len, seed, id,
  array_to_string([substr('{AMINO_ACIDS}', CAST({hash_sql("CAST(seed AS VARCHAR)", "'Mock'",
    "CAST(frag_len AS VARCHAR)", "CAST(id AS VARCHAR)", "CAST(j AS VARCHAR)")} % 20 AS INTEGER) + 1, 1)
    FOR j IN range(1, frag_len + 1)], '') AS fragment
FROM draw""",
)
def q_frag_mock(spark, sf_dir):
    return fragments.sample_mock(spark, LENS, SEEDS, table(spark, sf_dir, "documents").count())


# --- contact scale derived from the texts -----------------------------------------------------------------

_SCALE_PAIRS_SQL = f"""adj AS (
  SELECT lang, substr(word, i, 2) AS pair FROM (
    SELECT lang, word, unnest(range(1, length(word))) AS i FROM w
    WHERE regexp_full_match(word, '[{AMINO_ACIDS}]{{2,}}'))),
given AS (SELECT lang AS aaindex_id, pair, CAST(count(*) AS DOUBLE) AS value FROM adj GROUP BY 1, 2)"""


@query(
    "aacp_matrix",
    f"""WITH {WORDS_SQL}, {_SCALE_PAIRS_SQL},
u AS (SELECT *, 0 AS prio FROM given UNION ALL SELECT aaindex_id, reverse(pair), value, 1 FROM given),
f AS (SELECT aaindex_id, pair, value FROM u
      QUALIFY row_number() OVER (PARTITION BY aaindex_id, pair ORDER BY prio) = 1),
s AS (SELECT * FROM f UNION ALL SELECT aaindex_id || 'inv', pair, -value FROM f),
m AS (SELECT aaindex_id, min(value) AS lo, max(value) AS hi FROM s GROUP BY 1)
SELECT aaindex_id, substr(pair, 1, 1) AS aa1, substr(pair, 2, 1) AS aa2,
       {r('CASE WHEN hi = lo THEN 0.5 ELSE (value - lo) / (hi - lo) END', 'value', 9)}
FROM s JOIN m USING (aaindex_id)""",
)
def q_aacp_matrix(spark, sf_dir):
    """Adjacent-residue counts per language play the part of the raw contact table."""
    clean = word_rows(spark, sf_dir).where(F.col("word").rlike(f"^[{AMINO_ACIDS}]{{2,}}$"))
    pairs = clean.select(
        F.col("lang").alias("aaindex_id"),
        F.explode(
            F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
        ).alias("pair"),
    )
    counted = pairs.groupBy("aaindex_id", "pair").agg(F.count("*").cast("double").alias("value"))
    return rounded(contact_scales.contact_matrices(counted), ["value"], 9)


# --- profiling --------------------------------------------------------------------------------------------


def _scales(spark):
    return contact_scales.contact_matrices(contact_scales.rule_scale(spark))


def library(spark, sf_dir):
    freq = stage(fragments.fragment_freq(receptors(spark, sf_dir), "cdr3b", CPP_LENS))
    return fragments.sample_deduplicated(freq, CPP_LENS, SEEDS, CPP_LIBRARY_DEPTH).unionByName(
        fragments.sample_weighted(freq, CPP_LENS, SEEDS, CPP_LIBRARY_DEPTH)
    )


def _value_sql(a: str, b: str) -> str:
    i, j = f"(strpos('{AMINO_ACIDS}', {a}) - 1)", f"(strpos('{AMINO_ACIDS}', {b}) - 1)"
    return f"((7 * {i} + 7 * {j} + {i} * {j}) % 20)"


def _window_score_sql(fragment: str, window: str, frag_len: int) -> str:
    terms = [_value_sql(f"substr({fragment}, {k}, 1)", f"substr({window}, {k}, 1)") for k in range(1, frag_len + 1)]
    return " + ".join(terms)


CPP_LIBRARY_SQL = f"""{RECEPTORS_SQL}, {fragments_sql(CPP_LENS)}, {draws_sql(CPP_LENS, SEEDS, CPP_LIBRARY_DEPTH)},
{DEDUP_SQL}, {WEIGHTED_SQL},
lib AS (
  SELECT library, frag_len, seed, fragment FROM (SELECT * FROM dedup UNION ALL SELECT * FROM weighted)
  QUALIFY row_number() OVER (PARTITION BY library, frag_len, seed ORDER BY
    {hash_sql("CAST(seed AS VARCHAR)", "library", "CAST(frag_len AS VARCHAR)", "CAST(id AS VARCHAR)")}, id)
    <= {CPP_DEPTH}),
pep AS (SELECT DISTINCT word AS peptide FROM w WHERE regexp_full_match(word, '[{AMINO_ACIDS}]{{8,11}}')),
win AS (
  SELECT peptide, l AS frag_len, unnest([substr(peptide, i, l) FOR i IN range(1, length(peptide) - l + 2)]) AS win
  FROM pep, (SELECT unnest({list(CPP_LENS)}) AS l)),
ws AS (
  SELECT f.frag_len, fragment, win,
    CASE f.frag_len {" ".join(f"WHEN {n} THEN {_window_score_sql('fragment', 'win', n)}" for n in CPP_LENS)} END AS v
  FROM (SELECT DISTINCT frag_len, fragment FROM lib) f JOIN (SELECT DISTINCT frag_len, win FROM win) x USING (frag_len)),
best AS (
  SELECT peptide, win.frag_len, fragment, max(v) / 19.0::DOUBLE AS hi, min(v) / 19.0::DOUBLE AS lo
  FROM win JOIN ws USING (frag_len, win) GROUP BY 1, 2, 3),
score AS (
  SELECT peptide, 'SYN01' AS aaindex_id, frag_len, library, seed, hi AS x FROM best JOIN lib USING (frag_len, fragment)
  UNION ALL
  SELECT peptide, 'SYN01inv', frag_len, library, seed, frag_len - lo FROM best JOIN lib USING (frag_len, fragment))"""

_KEY = "peptide, aaindex_id, frag_len, library, seed"


def stats_sql(keys: str, source: str, value: str) -> str:
    """Eleven statistics of ``value`` per key, written from their definitions."""
    return f"""mom AS (
  SELECT {keys}, count(*) AS n, avg({value}) AS mu, stddev_samp({value}) AS sd, quantile_cont({value}, 0.5) AS med,
    quantile_cont({value}, 0.1) AS q10, quantile_cont({value}, 0.25) AS q25, quantile_cont({value}, 0.75) AS q75,
    quantile_cont({value}, 0.9) AS q90, list_sort(list({value})) AS xs, min({value}) AS lo, max({value}) AS hi
  FROM {source} GROUP BY ALL),
cen AS (
  SELECT {keys}, sum(power({value} - mu, 3)) AS m3, sum(power({value} - mu, 4)) AS m4,
         quantile_cont(abs({value} - med), 0.5) AS mad
  FROM {source} JOIN mom USING ({keys}) GROUP BY ALL),
st AS (
  SELECT mom.*, mad,
    CASE WHEN sd > 1e-12 THEN m3 / n / power(sd, 3) END AS skew,
    CASE WHEN sd > 1e-12 THEN m4 / n / power(sd, 4) - 3 END AS kurt,
    list_avg(xs[CAST(floor(n * 0.1) AS BIGINT) + 1 : n - CAST(floor(n * 0.1) AS BIGINT)]) AS trm
  FROM mom JOIN cen USING ({keys}))"""


STAT_COLUMNS = {
    "Mean": "mu",
    "SD": "sd",
    "Med": "med",
    "TrM": "trm",
    "MAD": "1.4826 * mad",
    "Skew": "skew",
    "Kurt": "kurt",
    "SE": "sd / sqrt(n)",
    "IQR": "q75 - q25",
    "Q10": "q10",
    "Q90": "q90",
}


@query(
    "cpp_stats",
    f"""WITH {CPP_LIBRARY_SQL}, {stats_sql(_KEY, 'score', 'x')}
SELECT peptide, aaindex_id, CAST(frag_len AS INTEGER) AS frag_len, {CPP_DEPTH} AS frag_depth, library, seed,
  {", ".join(r(e, f'"{s}"') for s, e in STAT_COLUMNS.items())} FROM st""",
)
def q_cpp_stats(spark, sf_dir):
    stats = contact_profile.cpp_stats(
        peptides(spark, sf_dir), library(spark, sf_dir), _scales(spark), depth=CPP_DEPTH, frag_lens=CPP_LENS
    )
    return rounded(stats, CPP_STATS)


CPP_FEATURES = sorted(f"CPP_{s}_{t}_{n}" for s in ("SYN01", "SYN01inv") for t in CPP_STATS for n in CPP_LENS)


def _feature_sql(name: str) -> str:
    _, scale, stat, frag_len = name.split("_")
    return r(
        f"avg({STAT_COLUMNS[stat]}) FILTER (aaindex_id = '{scale}' AND frag_len = {frag_len})", f'"{name}"'
    )


CPP_FEATURES_SQL = f"""WITH {CPP_LIBRARY_SQL}, {stats_sql(_KEY, 'score', 'x')}
SELECT peptide, {CPP_DEPTH} AS frag_depth, library, {", ".join(_feature_sql(n) for n in CPP_FEATURES)}
FROM st GROUP BY peptide, library"""


@query("cpp_features", CPP_FEATURES_SQL)
def q_cpp_features(spark, sf_dir):
    wide = contact_profile.cpp_features(
        peptides(spark, sf_dir), library(spark, sf_dir), _scales(spark), depth=CPP_DEPTH, frag_lens=CPP_LENS
    )
    return rounded(wide, CPP_FEATURES)


PRUNED = ["CPP_SYN01_Mean_3", "CPP_SYN01inv_Q90_4"]


@query(
    "cpp_features_pruned",
    f"""WITH {CPP_LIBRARY_SQL}, {stats_sql(_KEY, 'score', 'x')}
SELECT peptide, {CPP_DEPTH} AS frag_depth, library, {", ".join(_feature_sql(n) for n in PRUNED)}
FROM st WHERE library = 'Weighted' GROUP BY peptide, library""",
)
def q_cpp_features_pruned(spark, sf_dir):
    """Only the (scale, length) pairs named by a feature list are scored."""
    wide = contact_profile.cpp_features(
        peptides(spark, sf_dir),
        library(spark, sf_dir),
        _scales(spark),
        depth=CPP_DEPTH,
        libraries=["Weighted"],
        feature_set=PRUNED,
    )
    return rounded(wide, PRUNED)


@query(
    "distribution_stats",
    f"""WITH {stats_sql('l_returnflag', 'lineitem', 'l_extendedprice')}
SELECT l_returnflag, n, {r('lo', '"Min"', 4)}, {r('hi', '"Max"', 4)},
  {", ".join(r(e, f'"{s}"', 4) for s, e in STAT_COLUMNS.items())} FROM st""",
)
def q_distribution_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(distribution_stats(li, ["l_returnflag"], "l_extendedprice"), [*CPP_STATS, "Min", "Max"], 4)
