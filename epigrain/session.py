"""Session helpers: building a session and cutting lineage through shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "epigrain", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship_package(session)
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a scratch folder is used only for a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="epigrain-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder removed when the application ends."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they may not have it, or not on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="epigrain-package-")  # on the driver; Spark copies the archive to the executors
    atexit.register(shutil.rmtree, folder, True)
    package = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/epigrain", "zip", package.parent, package.name))


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Later branches read columns of the written table instead of recomputing the plan, and a lost executor
    costs a re-read, not the whole lineage.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    remove_at_end(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than cores; a scan that already fills the cluster is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by key into enough tasks for a compute-heavy stage (bytes alone would suggest too few)."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
