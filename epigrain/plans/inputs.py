"""Logical inputs derived from the driver tables, each as a DataFrame and as the matching SQL text.

The tables hold no peptides, so words of ``documents.text`` that spell standard residues stand in for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS, standard_pattern
from ..operators import ingest
from ..operators.sequences import sequence_filter, words
from ..session import widen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The text table; tokenising is heavy, so a single-split file is spread over the cores first."""
    return widen(table(spark, sf_dir, "documents").select(*columns))


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(documents(spark, sf_dir, "text", "doc_id", "lang", "source"), "text", ["doc_id", "lang", "source"])


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = words(documents(spark, sf_dir, "text")).select(F.col("word").alias("peptide"))
    return sequence_filter(tokens).distinct()


def scored_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptides with their number of occurrences as the score."""
    tokens = words(documents(spark, sf_dir, "text")).select(F.col("word").alias("peptide"))
    return sequence_filter(tokens).groupBy("peptide").agg(F.count("*").cast("double").alias("score"))


def receptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every standard-residue word of 8 to 16 letters, repeats included."""
    tokens = words(documents(spark, sf_dir, "text"))
    return tokens.where(F.col("word").rlike(standard_pattern(8, 16))).select(F.col("word").alias("cdr3b"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled observations: words of labelled documents with the document's quality as the label."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = word_rows(spark, sf_dir).join(labels, "doc_id")
    return ingest.to_raw(
        rows,
        peptide="word",
        immunogenicity=F.when(F.col("quality") == 1, "Positive").otherwise("Negative"),
        immunogenicity_evidence=F.concat(F.lit("ev"), F.col("toxic").cast("string")),
        mhc=F.concat_ws(", ", "lang", "source"),
        host="source",
        organism="lang",
        dataset="source",
    )


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label, a tied score in (0, 1] and a group for every line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_returnflag") == "R", "Positive").otherwise("Negative").alias("truth"),
        ((F.col("l_quantity") + F.col("l_discount") * 10) / 51).alias("prob"),
        F.col("l_linestatus").alias("group"),
    )


_AA = AMINO_ACIDS

WORDS_SQL = """w AS (
  SELECT doc_id, lang, source, upper(token) AS word
  FROM (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents))"""

PEPTIDES_SQL = (
    WORDS_SQL
    + f""",
pep AS (SELECT DISTINCT word AS peptide FROM w WHERE regexp_full_match(word, '[{_AA}]{{8,11}}'))"""
)

SCORED_SQL = (
    WORDS_SQL
    + f""",
pep AS (
  SELECT word AS peptide, CAST(count(*) AS DOUBLE) AS score
  FROM w WHERE regexp_full_match(word, '[{_AA}]{{8,11}}') GROUP BY word)"""
)

RECEPTORS_SQL = (
    WORDS_SQL
    + f""",
tcr AS (SELECT word AS cdr3b FROM w WHERE regexp_full_match(word, '[{_AA}]{{8,16}}'))"""
)

OBSERVATIONS_SQL = (
    WORDS_SQL
    + """,
raw AS (
  SELECT w.word AS peptide,
         CASE WHEN l.quality = 1 THEN 'Positive' ELSE 'Negative' END AS immunogenicity,
         'ev' || CAST(l.toxic AS VARCHAR) AS immunogenicity_evidence,
         w.lang || ', ' || w.source AS mhc,
         CAST(NULL AS VARCHAR) AS mhc_evidence,
         w.source AS host, w.lang AS organism, w.source AS dataset
  FROM w JOIN labels l USING (doc_id))"""
)

CLASSIFIED_SQL = """cls AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 'Positive' ELSE 'Negative' END AS truth,
         (l_quantity + l_discount * 10) / 51 AS prob, l_linestatus AS "group" FROM lineitem)"""


def hash_sql(*parts: str) -> str:
    """SQL of :func:`epigrain.functions.hashing.seeded_hash` for already-text parts."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"
