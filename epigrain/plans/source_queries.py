"""Queries over exports, tool scripts, binding results, clonotypes and stored features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..operators.sequences import peptide_basic
from ..session import checkpoint_dir
from ..sources import binding, clonotypes, features_io
from .inputs import PEPTIDES_SQL, WORDS_SQL, hash_sql, peptides, table, word_rows
from .registry import query

MAX_PEPTIDES = 500
DUMP_DIR, DUMP_TOOL = "/data/sra", "/opt/fastq-dump"

CHUNKS_SQL = (
    PEPTIDES_SQL
    + f""",
chunks AS (SELECT CAST(length(peptide) AS INTEGER) AS "length", CAST(ceil(row_number() OVER (
    PARTITION BY length(peptide) ORDER BY {hash_sql("'0'", 'peptide')}, peptide) / {MAX_PEPTIDES}.0) AS BIGINT) AS chunk,
  peptide FROM pep)"""
)


@query("netmhc_chunks", f"WITH {CHUNKS_SQL} SELECT * FROM chunks")
def q_netmhc_chunks(spark, sf_dir):
    return binding.peptide_chunks(peptides(spark, sf_dir), MAX_PEPTIDES)


def _command_sql(mhc_class: str) -> str:
    tool, flag = binding.TOOL_COMMAND[mhc_class]
    lengths = binding.TOOL_LENGTHS[mhc_class]
    return f"""SELECT '{mhc_class}' AS mhc_class, f AS file_name,
  '{tool} -a {binding.ALLELES[mhc_class]} {flag} ' || "length" || ' -xls -xlsfile ./Peptides/' ||
  replace(f, 'fasta', 'xls') || ' -f ./Peptides/' || f AS command
FROM files WHERE "length" BETWEEN {lengths[0]} AND {lengths[-1]}"""


@query(
    "netmhc_script",
    f"""WITH {CHUNKS_SQL},
files AS (SELECT DISTINCT "length", 'Peptides_' || "length" || 'mer_' || chunk || '.fasta' AS f FROM chunks)
{_command_sql("MHCI")} UNION ALL {_command_sql("MHCII")}""",
)
def q_netmhc_script(spark, sf_dir):
    return binding.tool_commands(binding.peptide_chunks(peptides(spark, sf_dir), MAX_PEPTIDES))


_CATEGORY_SQL = "CASE WHEN {0} <= {s} THEN 'StrongBinder' WHEN {0} <= {w} THEN 'WeakBinder' ELSE 'NonBinder' END"


@query(
    "binder_category",
    f"""SELECT event_id, value AS rank, {_CATEGORY_SQL.format('value', s=0.5, w=2)} AS category,
       CASE WHEN value <= 0.5 THEN 3 WHEN value <= 2 THEN 2 ELSE 1 END AS code
FROM events WHERE value IS NOT NULL""",
)
def q_binder_category(spark, sf_dir):
    events = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    rank = F.col("value")
    return events.select(
        "event_id", rank.alias("rank"), binding.binder_category(rank).alias("category"), binding.binder_code(rank).alias("code")
    )


_TYPES = binding.SUPERTYPES["MHCII"]
_RAW_BINDING_SQL = (
    WORDS_SQL
    + f""",
raw AS (SELECT substr(word, 1, 6) AS id, word AS peptide, {", ".join(
        f"({hash_sql(f"'{t}'", 'word')} % 1000) / 50.0::DOUBLE AS {t}" for t in _TYPES)}
  FROM (SELECT DISTINCT word FROM w WHERE length(word) BETWEEN 8 AND 11)),
first AS (SELECT * FROM (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY id ORDER BY peptide) = 1)
  WHERE NOT contains(peptide, 'X'))"""
)


def _binding(spark, sf_dir):
    rows = word_rows(spark, sf_dir).where(F.length("word").between(8, 11)).select("word").distinct()
    return rows.select(
        F.substring("word", 1, 6).alias("id"),
        F.col("word").alias("peptide"),
        *[((seeded_hash(t, F.col("word")) % 1000) / 50.0).alias(t) for t in _TYPES],
    )


@query(
    "netmhc_import",
    f"""WITH {_RAW_BINDING_SQL}
SELECT peptide, hla_restriction, rank, {_CATEGORY_SQL.format('rank', s=2, w=10)} AS binder_category
FROM (SELECT * EXCLUDE (id) FROM first) UNPIVOT (rank FOR hla_restriction IN ({", ".join(_TYPES)}))""",
)
def q_netmhc_import(spark, sf_dir):
    return binding.binding_tables(_binding(spark, sf_dir), "MHCII")["long"]


@query(
    "netmhc_import_bind",
    f"""WITH {_RAW_BINDING_SQL}
SELECT peptide, {", ".join(f"CASE WHEN {t} <= 2 THEN 3 WHEN {t} <= 10 THEN 2 ELSE 1 END AS {t}" for t in _TYPES)}
FROM first""",
)
def q_netmhc_import_bind(spark, sf_dir):
    return binding.binding_tables(_binding(spark, sf_dir), "MHCII")["bind"]


@query(
    "script_remaining",
    f"""SELECT DISTINCT 'SRR' || o_custkey AS accession,
  '{DUMP_TOOL} --outdir {DUMP_DIR} {clonotypes.DUMP_FLAGS} --accession SRR' || o_custkey AS command
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
)
def q_script_remaining(spark, sf_dir):
    def name(c):
        return F.concat(F.lit("SRR"), F.col(c).cast("string")).alias("accession")

    accessions = table(spark, sf_dir, "orders").select(name("o_custkey"))
    done = table(spark, sf_dir, "customer").where(F.col("c_acctbal") < 0).select(name("c_custkey"))
    return clonotypes.dump_commands(accessions, DUMP_DIR, DUMP_TOOL, done)


def _assembly_sql() -> str:
    d = "'D:\\' || accession"
    java = "java -jar -Xmx60G mixcr.jar "
    reads = (
        f"CASE n_files WHEN 1 THEN {d} || '_pass.fastq.gz' "
        f"ELSE {d} || '_pass_1.fastq.gz ' || {d} || '_pass_2.fastq.gz' END"
    )
    return f"""WITH runs AS (SELECT 'SRR' || o_custkey AS accession, count(*) AS n_files FROM orders GROUP BY 1)
SELECT accession, 'mkdir ' || {d} || chr(10)
  || '{java}align -s hsa -r ' || {d} || '\\log.txt ' || {reads} || ' ' || {d} || '\\alignments.vdjca' || chr(10)
  || '{java}assemble -r ' || {d} || '\\log.txt ' || {d} || '\\alignments.vdjca ' || {d} || '\\clones.clns' || chr(10)
  || '{java}exportClones ' || {d} || '\\clones.clns ' || {d} || '\\clones.txt' AS script
FROM runs WHERE n_files IN (1, 2)"""


@query("assembly_script", _assembly_sql())
def q_assembly_script(spark, sf_dir):
    """Orders stand for read files: a customer with one order is a single-end run, with two a paired-end run."""
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("SRR"), F.col("o_custkey").cast("string"), F.lit("_pass.fastq.gz")).alias("file_name")
    )
    return clonotypes.assembly_commands(clonotypes.read_counts(files), "D:", "mixcr.jar")


CLONES_SQL = (
    WORDS_SQL
    + """,
clones AS (SELECT word AS aa_seq_cdr3, source AS accession FROM w
  WHERE lang <> 'de' AND regexp_full_match(word, '[ACDEFGHIKLMNPQRSTVWY]+'))"""
)


def _clones(spark, sf_dir):
    rows = word_rows(spark, sf_dir).select(
        F.when(F.col("lang") != "de", "TRBV5-1*00(100)").otherwise("TRAV1-2*00(90)").alias("allVHitsWithScore"),
        F.col("word").alias("aaSeqCDR3"),
        F.col("source").alias("accession"),
    )
    return clonotypes.clonotypes(rows)


@query("clonotypes", f"WITH {CLONES_SQL} SELECT * FROM clones")
def q_clonotypes(spark, sf_dir):
    return _clones(spark, sf_dir)


@query(
    "clonotype_support",
    f"WITH {CLONES_SQL} SELECT aa_seq_cdr3, count(DISTINCT accession) AS n FROM clones GROUP BY 1",
)
def q_clonotype_support(spark, sf_dir):
    return clonotypes.clonotype_support(_clones(spark, sf_dir))


@query(
    "feature_io_roundtrip",
    f"""WITH {PEPTIDES_SQL}
SELECT peptide, CAST(length(peptide) AS INTEGER) AS Peptide_Length, 'Weighted' AS library, 9 AS frag_depth
FROM pep WHERE length(peptide) = 9""",
)
def q_feature_io_roundtrip(spark, sf_dir):
    """Written partitioned by (library, frag_depth) and read back with both partition filters."""
    features = peptide_basic(peptides(spark, sf_dir)).select(
        "peptide",
        "Peptide_Length",
        F.explode(F.array(F.lit("Weighted"), F.lit("Mock"))).alias("library"),
        F.col("Peptide_Length").alias("frag_depth"),
    )
    path = f"{checkpoint_dir(spark)}/features-{uuid.uuid4().hex}"
    features_io.save_features(features, path)
    back = features_io.read_features(spark, path, "Weighted", 9)
    return back.select("peptide", "Peptide_Length", "library", "frag_depth")
