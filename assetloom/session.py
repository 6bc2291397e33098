"""Session helpers shared by all operators: table reads, the shared folder, cutting lineage."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder, through Spark's reader only."""
    path = f"{sf_dir}/{name}.parquet"
    return spread(spark.read.parquet(path), path)


#: Rows of each part of tables in few files, and bytes that a table dealt anew has at most.
_ROWS: dict[tuple, list[int]] = {}
SPREAD_BYTES = 1 << 30


def _few_files(spark: SparkSession, path: str, most: int) -> list[tuple[str, int]] | None:
    """`(name, bytes)` of the files below a path; None if there are more than `most`. Stops listing there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append((str(f.getPath()), f.getLen()))
        if len(found) > most:
            return None
    return found


def spread(df: DataFrame, path: str, least: int = 5000) -> DataFrame:
    """A table as it is, but where it comes in fewer files and row groups than the session has cores, and has `least` rows
    or more, dealt to all cores: else one task would read a file that was written as one row group. Tables of more files or
    of more than `SPREAD_BYTES` are never moved, nor listed to the end. Only the footers of few files are read, once a session."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = _few_files(spark, path, cores - 1)
    if files is None or sum(n for _, n in files) > SPREAD_BYTES:
        return df
    key = (spark.sparkContext.applicationId, *sorted(files))
    if key not in _ROWS:
        _ROWS[key] = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    rows = _ROWS[key]
    return df.repartition(cores) if len(rows) < cores and sum(rows) >= least else df


def ready(spark: SparkSession) -> None:
    """Let Python workers that start on this host import the package from where the driver has it."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own;
    a cluster session fails, because a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file:///tmp/checkpoints/assetloom"


#: With this setting Spark deletes a job's shuffle files when it ends, and not when the driver collects its garbage.
NO_SHUFFLES_LEFT = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: lineage ends there, and shuffle files of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(NO_SHUFFLES_LEFT, None)
    spark.conf.set(NO_SHUFFLES_LEFT, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(NO_SHUFFLES_LEFT, before) if before is not None else spark.conf.unset(NO_SHUFFLES_LEFT)
    CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this process has cut, in order.
CUTS: list[str] = []


def drop_cuts(spark: SparkSession, paths: list[str]) -> None:
    """Delete cut tables that no frame will read any more."""
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        CUTS.remove(p)


#: Frames that stay for the session, by name; they read cut tables.
KEPT: dict[tuple, DataFrame] = {}


def clear_shared(spark: SparkSession) -> None:
    """Delete the tables that this application has cut; frames that read them can no longer run, and those kept by name are forgotten."""
    KEPT.clear()
    CUTS.clear()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
