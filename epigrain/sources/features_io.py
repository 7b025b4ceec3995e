"""Feature tables and intermediate results on shared storage."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_features(table: DataFrame, path: str) -> None:
    """Feature table as Parquet partitioned by (library, frag_depth), so a reader scans only what it asks for."""
    table.write.mode("overwrite").partitionBy("library", "frag_depth").parquet(path)


def read_features(spark: SparkSession, path: str, library: str | None = None, frag_depth: int | None = None) -> DataFrame:
    table = spark.read.parquet(path)
    if library is not None:
        table = table.where(F.col("library") == library)
    if frag_depth is not None:
        table = table.where(F.col("frag_depth") == frag_depth)
    return table


def parameters_from_file_name(file_name: str) -> tuple[str, ...]:
    """Parameters of a file named ``<header>_<library>.<depth>[.<seed>].parquet``."""
    stem = file_name.rsplit("/", 1)[-1]
    for suffix in (".parquet", ".fst", ".rds"):
        stem = stem.removesuffix(suffix)
    return tuple(stem.rsplit("_", 1)[-1].split("."))


def save_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).csv(path)


def parameter_key(**parameters) -> str:
    """Short digest of a parameter set; results of other parameters are never picked up by mistake."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def resume(spark: SparkSession, root: str, stage_name: str, build: Callable[[], DataFrame], **parameters) -> DataFrame:
    """Read a finished stage from ``root`` or build and write it; keyed by name and parameters.

    Spark writes the ``_SUCCESS`` marker last, so a folder left by a lost job counts as absent.
    """
    path = f"{root}/{stage_name}-{parameter_key(**parameters)}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume_seeds(
    spark: SparkSession, root: str, stage_name: str, seeds, build: Callable[[int], DataFrame], **parameters
) -> DataFrame:
    """Seed-level resume: only seeds without a finished result are built."""
    out = None
    for seed in seeds:
        part = resume(spark, root, stage_name, lambda s=seed: build(s), seed=seed, **parameters)
        out = part if out is None else out.unionByName(part)
    return out
