"""Tables in the folder that driver and executors share, and folders that change places."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session (tests) gets
    a temporary one; on a cluster it is an error, as a folder of one machine would lose what others write."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="casegraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; Spark removes it once nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut and a lost executor loses nothing. Whoever cleans the
    folder removes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    files, where = _at(spark, path)
    files.delete(where, True)


def replace(spark: SparkSession, new: str, path: str) -> None:
    """Puts the folder `new` in the place of `path`, whose old content goes last. If a step fails both are still there."""
    files, target = _at(spark, path)
    source, old = spark._jvm.org.apache.hadoop.fs.Path(new), spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-old-{uuid.uuid4().hex}")
    had = files.exists(target)
    if had and not files.rename(target, old):
        raise OSError(f"cannot move {path} aside; the new table is in {new}")
    if not files.rename(source, target):
        raise OSError(f"cannot move {new} to {path}; the old table is in {old}")
    if had:
        files.delete(old, True)
