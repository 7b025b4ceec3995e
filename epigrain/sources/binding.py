"""MHC binding predictions: peptide export, tool command lines, result import."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import hash_rank
from ..operators.relational import keep_first

# Allele lists passed to the tools, supertypes in result-column order, rank thresholds
# (weak, strong) and peptide lengths per class.
ALLELES = {
    "MHCI": "HLA-A0101,HLA-A0201,HLA-A0301,HLA-A2402,HLA-A2601,HLA-B0702,HLA-B0801,HLA-B2705,HLA-B3901,HLA-B4001,"
    "HLA-B5801,HLA-B1501",
    "MHCII": "DRB1_0101,DRB3_0101,DRB4_0101,DRB5_0101,HLA-DPA10103-DPB10101,HLA-DQA10101-DQB10201",
}
SUPERTYPES = {
    "MHCI": ("A01", "A02", "A03", "A24", "A26", "B07", "B08", "B27", "B39", "B44", "B58", "B62"),
    "MHCII": ("DRB1", "DRB3", "DRB4", "DRB5", "DP", "DQ"),
}
RANK_THRESHOLDS = {"MHCI": (2.0, 0.5), "MHCII": (10.0, 2.0)}
TOOL_LENGTHS = {"MHCI": range(8, 12), "MHCII": range(11, 31)}
TOOL_COMMAND = {"MHCI": ("./netMHC", "-l"), "MHCII": ("./netMHCIIpan", "-length")}
BINDER_CATEGORIES = ("NonBinder", "WeakBinder", "StrongBinder")


def binder_level(rank: Column, mhc_class: str) -> Column:
    """0, 1 or 2 thresholds passed."""
    weak, strong = RANK_THRESHOLDS[mhc_class]
    return F.when(rank <= strong, 2).when(rank <= weak, 1).when(rank.isNotNull(), 0)


def binder_category(rank: Column, mhc_class: str = "MHCI") -> Column:
    level = binder_level(rank, mhc_class)
    out = F.when(level == 0, BINDER_CATEGORIES[0])
    for i, name in enumerate(BINDER_CATEGORIES[1:], start=1):
        out = out.when(level == i, name)
    return out


def binder_code(rank: Column, mhc_class: str = "MHCI") -> Column:
    """1-based category code: 1 non-binder, 2 weak, 3 strong."""
    return binder_level(rank, mhc_class) + 1


def peptide_chunks(peptides: DataFrame, max_peptides: int | None = None, seed: int = 0) -> DataFrame:
    """(length, chunk, peptide): distinct peptides cut into files of at most ``max_peptides`` per length.

    Positions come from bucketed hash ranks, so a dominant length is not numbered by one task.
    """
    sized = peptides.select("peptide").distinct().withColumn("length", F.length("peptide"))
    if max_peptides is None:
        return sized.select("length", F.lit(1).cast("long").alias("chunk"), "peptide")
    ranked = hash_rank(sized, seed, ["peptide"], ["length"])
    return ranked.select("length", F.ceil(F.col("rank") / max_peptides).alias("chunk"), "peptide")


def fasta_name(length: Column, chunk: Column) -> Column:
    return F.format_string("Peptides_%dmer_%d.fasta", length, chunk)


def write_fasta(chunks: DataFrame, out_dir: str) -> None:
    """FASTA text partitioned by length and chunk; each sequence is its own header."""
    text = F.concat(F.lit(">"), "peptide", F.lit("\n"), "peptide")
    chunks.select("length", "chunk", text.alias("value")).write.mode("overwrite").partitionBy("length", "chunk").text(
        out_dir
    )


def tool_commands(chunks: DataFrame) -> DataFrame:
    """(mhc_class, file_name, command): one command line per FASTA file and class that takes its length."""
    files = chunks.select("length", "chunk").distinct()
    name = fasta_name(F.col("length"), F.col("chunk"))
    rows = []
    for mhc_class, (tool, flag) in TOOL_COMMAND.items():
        lengths = TOOL_LENGTHS[mhc_class]
        command = F.concat(
            F.lit(f"{tool} -a {ALLELES[mhc_class]} {flag} "),
            F.col("length").cast("string"),
            F.lit(" -xls -xlsfile ./Peptides/"),
            F.replace(name, F.lit("fasta"), F.lit("xls")),
            F.lit(" -f ./Peptides/"),
            name,
        )
        fits = F.col("length").between(lengths[0], lengths[-1])
        rows.append(F.when(fits, F.struct(F.lit(mhc_class).alias("mhc_class"), name.alias("file_name"), command.alias("command"))))
    return files.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).select("r.*")


def write_commands(commands: DataFrame, out_dir: str) -> None:
    commands.select("mhc_class", F.col("command").alias("value")).write.mode("overwrite").partitionBy("mhc_class").text(
        out_dir
    )


def read_binding(spark: SparkSession, paths: str | Sequence[str], mhc_class: str = "MHCI") -> DataFrame:
    """(id, peptide, <supertype ranks>) from tab-separated result files; ``Rank`` columns by position."""
    table = spark.read.option("header", True).option("sep", "\t").csv(paths)
    base = [c.rstrip("0123456789") for c in table.columns]
    table = table.toDF(*[f"c{i}" for i in range(len(base))])
    ranks = [f"c{i}" for i, b in enumerate(base) if b == "Rank"]
    supertypes = SUPERTYPES[mhc_class]
    if len(ranks) != len(supertypes):
        raise ValueError(f"expected {len(supertypes)} Rank columns, found {len(ranks)}")
    return table.select(
        F.col(f"c{base.index('ID')}").alias("id"),
        F.col(f"c{base.index('Peptide')}").alias("peptide"),
        *[F.col(r).cast("double").alias(s) for r, s in zip(ranks, supertypes)],
    )


def binding_tables(wide: DataFrame, mhc_class: str = "MHCI") -> dict[str, DataFrame]:
    """Long table with categories, wide ranks and wide category codes.

    Repeated ids keep one row (the smallest peptide, then ranks); peptides with an ``X`` are dropped.
    """
    supertypes = list(SUPERTYPES[mhc_class])
    first = keep_first(wide, ["id"], ["peptide", *supertypes]).where(~F.contains(F.col("peptide"), F.lit("X"))).drop("id")
    long = first.unpivot(["peptide"], supertypes, "hla_restriction", "rank").withColumn(
        "binder_category", binder_category(F.col("rank"), mhc_class)
    )
    coded = first.select("peptide", *[binder_code(F.col(s), mhc_class).alias(s) for s in supertypes])
    return {"long": long, "rank": first, "bind": coded}
