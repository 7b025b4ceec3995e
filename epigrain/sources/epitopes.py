"""Readers for epitope observation files."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest

# Assay groups accepted as evidence of immunogenicity.
EVIDENCE_WHITELIST = (
    "activation",
    "antibody help",
    "CCL2/MCP-1 release",
    "CCL3/MIP-1a release",
    "CCL4/MIP-1b release",
    "CCL5/RANTES release",
    "CXCL10/IP-10 release",
    "CXCL9/MIG release",
    "cytotoxicity",
    "decreased disease",
    "degranulation",
    "disease exacerbation",
    "GM-CSF release",
    "granulysin release",
    "granzyme A release",
    "granzyme B release",
    "IFNg release",
    "IL-10 release",
    "IL-12 release",
    "IL-13 release",
    "IL-17 release",
    "IL-17A release",
    "IL-1b release",
    "IL-2 release",
    "IL-21 release",
    "IL-22 release",
    "IL-23 release",
    "IL-3 release",
    "IL-4 release",
    "IL-5 release",
    "IL-6 release",
    "IL-8 release",
    "lymphotoxin A/TNFb release",
    "pathogen burden after challenge",
    "perforin release",
    "proliferation",
    "protection from challenge",
    "survival from challenge",
    "T cell- APC binding",
    "T cell help",
    "TGFb release",
    "TNF release",
    "TNFa release",
    "tolerance",
    "tumor burden after challenge",
    "type IV hypersensitivity (DTH)",
)
# 1-based positions of two columns whose header text is not unique in the assay export.
DESCRIPTION_ORDINAL, SPECIES_ORDINAL = 12, 50


def read_epitope_csv(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Peptide, Immunogenicity, MHC, Dataset files as raw observations; empty and ``NA`` are missing."""
    rows = (
        spark.read.option("header", True)
        .option("nullValue", "NA")
        .option("emptyValue", "")
        .schema("Peptide string, Immunogenicity string, MHC string, Dataset string")
        .csv(paths)
    )
    return ingest.to_raw(
        rows,
        peptide="Peptide",
        immunogenicity="Immunogenicity",
        mhc=F.when(F.col("MHC") != "", F.col("MHC")),
        dataset="Dataset",
    )


def read_lookup(spark: SparkSession, path: str) -> DataFrame:
    """First column of a lookup file."""
    table = spark.read.option("header", True).csv(path)
    return table.select(table.columns[0])


def evidence_table(spark: SparkSession, evidence: Iterable[str] = EVIDENCE_WHITELIST) -> DataFrame:
    return spark.createDataFrame([(e,) for e in evidence], "evidence string")


def read_assay_export(spark: SparkSession, path: str, evidence: DataFrame | None = None) -> DataFrame:
    """Assay export with a banner line and then the real header line.

    The banner is consumed as the CSV header; the real header is the first remaining line.  Columns
    with repeated header text are taken by position, the others by name without blanks.  Files are cut into ranges for
    several tasks unless a record goes over several lines, which takes a pass to tell; then a task reads a whole file.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    over_lines = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    table = spark.read.option("header", True).option("multiLine", over_lines).option("escape", '"').option(
        "nullValue", "NA"
    ).csv(path)
    names = [f"c{i}" for i in range(1, len(table.columns) + 1)]
    top = table.where("_metadata.file_block_start = 0").first()
    table = table.toDF(*names)
    header = {}
    for i, text in enumerate(top, start=1):
        header.setdefault((text or "").replace(" ", ""), f"c{i}")
    description, species = f"c{DESCRIPTION_ORDINAL}", f"c{SPECIES_ORDINAL}"
    measure = header["QualitativeMeasure"]
    rows = table.where(F.coalesce(F.replace(F.col(measure), F.lit(" "), F.lit("")) != "QualitativeMeasure", F.lit(True)))
    raw = ingest.to_raw(
        rows,
        peptide=description,
        immunogenicity=ingest.label_from_text(F.col(measure)),
        immunogenicity_evidence=header["AssayGroup"],
        mhc=header["AlleleName"],
        mhc_evidence=header["AlleleEvidenceCode"],
        host=header["Name"],
        organism=species,
        dataset=F.lit("IEDB"),
    )
    return ingest.evidence_semi(raw, evidence if evidence is not None else evidence_table(spark)).select(
        *ingest.RAW_COLUMNS
    )


def import_epitopes(
    spark: SparkSession,
    assay_export: str | None = None,
    other_files: Sequence[str] = (),
    lengths: Iterable[int] = range(8, 12),
) -> DataFrame:
    """Read all given files and consolidate them to one row per peptide."""
    frames = []
    if assay_export is not None:
        frames.append(read_assay_export(spark, assay_export))
    if other_files:
        frames.append(read_epitope_csv(spark, list(other_files)))
    if not frames:
        raise ValueError("give an assay export or other epitope files")
    raw = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return ingest.epitope_import(raw, lengths)
