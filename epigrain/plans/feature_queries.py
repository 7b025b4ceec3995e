"""Queries over descriptors, full feature tables, single-receptor profiles and the end-to-end ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS, standard_pattern
from ..functions.names import DESCRIPTOR_STATS, SINGLE_CPP_STATS
from ..operators import contact_profile, descriptors, fragments, sequences, single_receptor
from ..session import stage
from ..sources import contact_scales
from . import prioritization
from .inputs import PEPTIDES_SQL, peptides, receptors, table, word_rows
from .model_queries import epitopes
from .profile_queries import (
    CPP_DEPTH,
    CPP_LENS,
    CPP_LIBRARY_SQL,
    PRUNED,
    _feature_sql,
    _KEY,
    _scales,
    _window_score_sql,
    library,
    stats_sql,
)
from .registry import query, r, rounded

DESC_LENS = (3, 4)
DESC_NAMES = ("AliphaticIndex", "BLOSUM1", "Boman", "Charge", "Hydrophobicity", "Z1")
DESC_FEATURES = [f"PeptDesc_{d}_{s}_{n}" for n in DESC_LENS for d in DESC_NAMES for s in DESCRIPTOR_STATS]


def rule_value(k: int, i: int) -> float:
    """Made-up residue values for the table-driven families: ((7k + 11i + ki) mod 23) / 22."""
    return (7 * k + 11 * i + k * i) % 23 / 22


def residue_table(spark):
    rows = [(d, a, rule_value(k, i)) for k, d in enumerate(("BLOSUM1", "Z1"), 1) for i, a in enumerate(AMINO_ACIDS)]
    return spark.createDataFrame(rows, "descriptor string, aa string, value double")


def _charge_share(a: str) -> float:
    pk, ph = descriptors.PK_LEHNINGER, descriptors.CHARGE_PH
    if a in descriptors.BASIC:
        return 1 / (1 + 10 ** (ph - pk[a]))
    return -1 / (1 + 10 ** (pk[a] - ph)) if a in descriptors.ACIDIC else 0.0


def _descriptor_sql() -> str:
    """Window value = slope * sum of residue values / (width or 1) + constant, as rows of a lookup table."""
    pk, ph = descriptors.PK_LEHNINGER, descriptors.CHARGE_PH
    ends = 1 / (1 + 10 ** (ph - pk["nterm"])) - 1 / (1 + 10 ** (pk["cterm"] - ph))
    rows = []
    for i, a in enumerate(AMINO_ACIDS):
        rows += [
            ("AliphaticIndex", a, 100 * descriptors.ALIPHATIC.get(a, 0.0), True, 0.0),
            ("BLOSUM1", a, rule_value(1, i), True, 0.0),
            ("Boman", a, -descriptors.TRANSFER[a], True, 0.0),
            ("Charge", a, _charge_share(a), False, ends),
            ("Hydrophobicity", a, descriptors.HYDROPATHY[a], True, 0.0),
            ("Z1", a, rule_value(2, i), True, 0.0),
        ]
    values = ", ".join(f"('{d}', '{a}', {v!r}::DOUBLE, {m}, {c!r}::DOUBLE)" for d, a, v, m, c in rows)
    return f"sc(descriptor, aa, value, is_mean, base) AS (VALUES {values})"


_DESC_WINDOWS_SQL = f"""{_descriptor_sql()},
win AS (SELECT peptide, l, unnest([substr(peptide, i, l) FOR i IN range(1, length(peptide) - l + 2)]) AS win
  FROM pep, (SELECT unnest({list(DESC_LENS)}) AS l)),
let AS (SELECT l, win, substr(win, k, 1) AS aa FROM (
  SELECT l, win, unnest(range(1, l + 1)) AS k FROM (SELECT DISTINCT l, win FROM win))),
wv AS (SELECT l, win, descriptor, CASE WHEN is_mean THEN sum(value) / l ELSE sum(value) + base END AS v
  FROM let JOIN sc USING (aa) GROUP BY l, win, descriptor, is_mean, base),
d AS (SELECT peptide, l, descriptor, min(v) AS "Min", max(v) AS "Max", avg(v) AS "Mean", median(v) AS "Median"
  FROM win JOIN wv USING (l, win) GROUP BY 1, 2, 3)"""


def _desc_columns() -> str:
    out = []
    for name in DESC_FEATURES:
        _, d, s, n = name.split("_")
        out.append(r(f"""max("{s}") FILTER (descriptor = '{d}' AND l = {n})""", f'"{name}"', 9))
    return ", ".join(out)


@query(
    "peptdesc_stats",
    f"WITH {PEPTIDES_SQL}, {_DESC_WINDOWS_SQL} SELECT peptide, {_desc_columns()} FROM d GROUP BY peptide",
)
def q_peptdesc_stats(spark, sf_dir):
    wide = descriptors.peptdesc_features(
        peptides(spark, sf_dir), DESC_LENS, residue_table(spark), feature_set=DESC_FEATURES
    )
    return rounded(wide, DESC_FEATURES, 9)


@query("peptdesc_all")
def q_peptdesc_all(spark, sf_dir):
    """Every closed-form descriptor, isoelectric point and hydrophobic moment included, at all lengths."""
    return descriptors.peptdesc_features(peptides(spark, sf_dir), residue_table=residue_table(spark))


FULL_FEATURES = ["Peptide_Length", "Peptide_ContainL", *PRUNED]


@query(
    "features",
    f"""WITH {CPP_LIBRARY_SQL}, {stats_sql(_KEY, 'score', 'x')}
SELECT peptide, CAST(length(peptide) AS INTEGER) AS Peptide_Length,
  CAST(contains(peptide, 'L') AS DOUBLE) AS Peptide_ContainL, {CPP_DEPTH} AS frag_depth, library,
  {", ".join(_feature_sql(n) for n in PRUNED)}
FROM st GROUP BY peptide, library""",
)
def q_features(spark, sf_dir):
    words = stage(peptides(spark, sf_dir))
    described = descriptors.peptdesc_features(words, CPP_LENS, feature_set=FULL_FEATURES)
    profiled = contact_profile.cpp_features(
        words, library(spark, sf_dir), _scales(spark), depth=CPP_DEPTH, feature_set=PRUNED
    )
    return rounded(descriptors.features(described, profiled), PRUNED)


# --- one receptor per peptide -----------------------------------------------------------------------------

SCPP_LENS = (3, 4)
#: The lengths that receptors are profiled at by default, for the statistics.
SCPP_STATS_LENS = (3, 4, 5, 6, 7, 8)


def receptor_pairs(spark, sf_dir):
    """Each peptide of a document with the alphabetically first receptor word of that document."""
    # peptides are receptor words too, so the texts are taken apart once
    rows = stage(word_rows(spark, sf_dir).where(F.col("word").rlike(standard_pattern(8, 16))).select("doc_id", "word"))
    first = rows.groupBy("doc_id").agg(F.min("word").alias("cdr3b"))
    return (
        sequences.sequence_filter(rows.withColumnRenamed("word", "peptide"))
        .join(first, "doc_id")
        .select("peptide", "cdr3b")
        .distinct()
    )


def _scpp_sql(lens) -> str:
    return f"""{PEPTIDES_SQL},
fst AS (SELECT doc_id, min(word) AS cdr3b FROM w WHERE regexp_full_match(word, '[{AMINO_ACIDS}]{{8,16}}') GROUP BY 1),
pairs AS (SELECT DISTINCT word AS peptide, cdr3b FROM w JOIN fst USING (doc_id)
  WHERE regexp_full_match(word, '[{AMINO_ACIDS}]{{8,11}}')),
fw AS (SELECT cdr3b, l, unnest([substr(cdr3b, i, l) FOR i IN range(1, length(cdr3b) - l + 2)]) AS f
  FROM (SELECT DISTINCT cdr3b FROM pairs), (SELECT unnest({list(lens)}) AS l)),
fr AS (SELECT cdr3b, l, f FROM fw UNION ALL SELECT cdr3b, l, reverse(f) FROM fw),
win AS (SELECT peptide, l, unnest([substr(peptide, i, l) FOR i IN range(1, length(peptide) - l + 2)]) AS win
  FROM pep, (SELECT unnest({list(lens)}) AS l)),
need AS (SELECT DISTINCT peptide, l, f FROM pairs JOIN fr USING (cdr3b)),
fwin AS (SELECT DISTINCT l, f, win FROM need JOIN win USING (peptide, l)),
ws AS (SELECT l, f, win, CASE l {" ".join(f"WHEN {n} THEN {_window_score_sql('f', 'win', n)}" for n in lens)} END AS v
  FROM fwin),
best AS (SELECT peptide, l, f, max(v) / 19.0::DOUBLE AS hi, min(v) / 19.0::DOUBLE AS lo
  FROM need JOIN win USING (peptide, l) JOIN ws USING (l, f, win) GROUP BY 1, 2, 3),
score AS (
  SELECT peptide, cdr3b, 'SYN01' AS aaindex_id, l AS frag_len, hi AS x
  FROM pairs JOIN fr USING (cdr3b) JOIN best USING (peptide, l, f)
  UNION ALL SELECT peptide, cdr3b, 'SYN01inv', l, l - lo
  FROM pairs JOIN fr USING (cdr3b) JOIN best USING (peptide, l, f))"""


_SINGLE = {"Max": "hi", "Min": "lo", "Mean": "mu", "SD": "sd", "Skew": "skew", "Kurt": "kurt"}


@query(
    "scpp_stats",
    f"""WITH {_scpp_sql(SCPP_STATS_LENS)}, {stats_sql('peptide, cdr3b, aaindex_id, frag_len', 'score', 'x')}
SELECT peptide, cdr3b, aaindex_id, CAST(frag_len AS INTEGER) AS frag_len,
  {", ".join(r(e, f'"{s}"', 9) for s, e in _SINGLE.items())} FROM st""",
)
def q_scpp_stats(spark, sf_dir):
    out = single_receptor.scpp_stats(receptor_pairs(spark, sf_dir), _scales(spark), None, SCPP_STATS_LENS)
    return rounded(out, SINGLE_CPP_STATS, 9)


SCPP_FEATURES = {
    f"sCPP_{scale}_{stat}_{n}": f"max({e}) FILTER (aaindex_id = '{scale}' AND frag_len = {n})"
    for scale in ("SYN01", "SYN01inv") for stat, e in _SINGLE.items() for n in SCPP_LENS
}


@query(
    "scpp_features",
    f"""WITH {_scpp_sql(SCPP_LENS)}, {stats_sql('peptide, cdr3b, aaindex_id, frag_len', 'score', 'x')}
SELECT peptide, cdr3b, {", ".join(r(e, f'"{name}"') for name, e in SCPP_FEATURES.items())} FROM st GROUP BY peptide, cdr3b""",
)
def q_scpp_features(spark, sf_dir):
    out = single_receptor.scpp_features(receptor_pairs(spark, sf_dir), _scales(spark), None, SCPP_LENS)
    return rounded(out, list(SCPP_FEATURES))


# --- end to end -------------------------------------------------------------------------------------------

E2E_FEATURES = ["Peptide_Length", "Peptide_ContainL", "PeptDesc_Hydrophobicity_Mean_3", "CPP_SYN01_Mean_3",
                "CPP_SYN01_SD_3", "CPP_SYN01inv_Q90_4"]


@query("prioritize_e2e")
def q_prioritize_e2e(spark, sf_dir):
    """Train on labelled document words, then mutate, score, connect and rank every benchmark word."""
    settings = prioritization.Settings(
        frag_lens=(3, 4), depth=CPP_DEPTH, library="Weighted", feature_set=E2E_FEATURES, seeds=(1, 2), n_trees=4,
        all_targets=False,  # only the ranked originals are returned
    )
    freq = stage(fragments.fragment_freq(receptors(spark, sf_dir), "cdr3b", (3, 4)))
    sampled = fragments.sample_weighted(freq, (3, 4), settings.seeds, 300)
    scales = contact_scales.contact_matrices(contact_scales.rule_scale(spark))
    labelled = stage(epitopes(spark, sf_dir).select("peptide", "immunogenicity"))
    training = prioritization.feature_table(labelled.select("peptide"), sampled, scales, settings)
    originals = sequences.sequence_filter(
        sequences.words(table(spark, sf_dir, "benchmark")).select(F.col("word").alias("peptide"))
    )
    return prioritization.prioritize_epitopes(training, labelled, originals, sampled, scales, settings)
