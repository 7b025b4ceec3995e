"""Receptor sequencing: clonotype tables and the command lines that produce them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alphabet import AMINO_ACIDS

# Read-dump flags, and the steps of both assembly workflows (`{n}` stands for an input).
DUMP_FLAGS = "--gzip --skip-technical  --readids --read-filter pass --dumpbase --split-files --clip"
STEPS = {
    False: (
        ("align -s {species}", "{reads}", "alignments.vdjca"),
        ("assemble", "alignments.vdjca", "clones.clns"),
    ),
    True: (
        ("align -p rna-seq -OallowPartialAlignments=true -s {species}", "{reads}", "alignments.vdjca"),
        ("assemblePartial", "alignments.vdjca", "alignments_rescued_1.vdjca"),
        ("assemblePartial", "alignments_rescued_1.vdjca", "alignments_rescued_2.vdjca"),
        ("extend", "alignments_rescued_2.vdjca", "alignments_extended.vdjca"),
        ("assemble", "alignments_extended.vdjca", "clones.clns"),
    ),
}


def read_clone_files(spark: SparkSession, path: str | Sequence[str], accession_index: int = 4) -> DataFrame:
    """Tab-separated clone tables found recursively; the accession is a component of each file's path.

    ``accession_index`` is 1-based from the left, or negative from the right.
    """
    table = (
        spark.read.option("header", True)
        .option("sep", "\t")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*clones.txt")
        .csv(path)
    )
    parts = F.split(F.input_file_name(), "/")
    return table.select("allVHitsWithScore", "aaSeqCDR3", F.element_at(parts, accession_index).alias("accession"))


def clonotypes(table: DataFrame, upper_only: bool = False) -> DataFrame:
    """(aa_seq_cdr3, accession) of beta chains made of standard residues; lower case passes unless ``upper_only``."""
    sequence = F.col("aaSeqCDR3")
    checked = sequence if upper_only else F.upper(sequence)
    return table.where(
        F.contains(F.col("allVHitsWithScore"), F.lit("TRB")) & checked.rlike(f"^[{AMINO_ACIDS}]+$")
    ).select(sequence.alias("aa_seq_cdr3"), "accession")


def clonotype_support(rows: DataFrame) -> DataFrame:
    """Number of accessions that contain each sequence.

    Written as distinct then count: both steps combine map-side, so a sequence seen everywhere is
    reduced before it is shuffled.
    """
    return rows.distinct().groupBy("aa_seq_cdr3").agg(F.count("accession").alias("n"))


def accession_of_file(file_name: Column) -> Column:
    return F.element_at(F.split(file_name, "_"), 1)


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Names of matching files under a folder, found recursively without reading their content."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def dump_commands(accessions: DataFrame, out_dir: str, tool_path: str, done: DataFrame | None = None) -> DataFrame:
    """(accession, command) for accessions without a finished file."""
    todo = accessions.select("accession").distinct()
    if done is not None:
        todo = todo.join(done.select("accession"), "accession", "left_anti")
    command = F.concat(F.lit(f"{tool_path} --outdir {out_dir} {DUMP_FLAGS} --accession "), "accession")
    return todo.select("accession", command.alias("command"))


def read_counts(files: DataFrame) -> DataFrame:
    """(accession, n_files): one file is a single-end run, two a paired-end run."""
    return files.select(accession_of_file(F.col("file_name")).alias("accession")).groupBy("accession").agg(
        F.count("*").alias("n_files")
    )


def assembly_commands(
    runs: DataFrame,
    base_dir: str,
    jar: str,
    memory: str = "60G",
    rnaseq: bool = False,
    species: str = "hsa",
    done: DataFrame | None = None,
) -> DataFrame:
    """(accession, script): the command block of each run that has no clone table yet."""
    todo = runs if done is None else runs.join(done.select("accession"), "accession", "left_anti")
    folder = F.concat(F.lit(f"{base_dir}\\"), "accession")
    reads = F.when(F.col("n_files") == 1, F.concat(folder, F.lit("_pass.fastq.gz"))).when(
        F.col("n_files") == 2, F.concat(folder, F.lit("_pass_1.fastq.gz "), folder, F.lit("_pass_2.fastq.gz"))
    )
    java = f"java -jar -Xmx{memory} {jar} "
    lines = [F.concat(F.lit("mkdir "), folder)]
    for action, source, target in STEPS[rnaseq]:
        given = reads if source == "{reads}" else F.concat(folder, F.lit(f"\\{source}"))
        lines.append(
            F.concat(
                F.lit(java + action.format(species=species) + " -r "),
                folder,
                F.lit("\\log.txt "),
                given,
                F.lit(" "),
                folder,
                F.lit(f"\\{target}"),
            )
        )
    lines.append(
        F.concat(F.lit(java + "exportClones "), folder, F.lit("\\clones.clns "), folder, F.lit("\\clones.txt"))
    )
    return todo.where(reads.isNotNull()).select("accession", F.concat_ws("\n", *lines).alias("script"))


def write_script(commands: DataFrame, column: str, path: str) -> None:
    """One text folder with a command (block) per line, ordered by accession."""
    commands.orderBy("accession").select(F.col(column).alias("value")).write.mode("overwrite").text(path)
