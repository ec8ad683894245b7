"""Folders that all executors share, and writes that replace a table safely."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir.

    Where that is unset, below a local one if the session runs in one process;
    a cluster has no folder that all its machines share unless it names one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file:///tmp/plumbline-shared"
    path = posixpath.join(base, f"{name}-{uuid.uuid4().hex}")
    _made.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the shared folders that this process made; call it when no result of theirs is read any more."""
    n = 0
    while _made:
        fs, p = _fs(spark, _made.pop())
        n += bool(fs.delete(p, True))
    return n


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and not fs.getFileStatus(p).isDirectory()


def status(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Which artifacts are there: (path, present)."""
    return spark.createDataFrame([(p, exists(spark, p)) for p in paths], "path string, present boolean")


def overwrite(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at `path`, also where `df` reads from it: written beside it, then moved."""
    spark = df.sparkSession
    staging, old = f"{path}.staging-{uuid.uuid4().hex[:8]}", f"{path}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(staging)
    fs, p = _fs(spark, path)
    had = fs.exists(p)
    if had:
        fs.rename(p, _fs(spark, old)[1])
    fs.rename(_fs(spark, staging)[1], p)
    if had:
        fs.delete(_fs(spark, old)[1], True)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def backup_once(spark: SparkSession, path: str, suffix: str = ".bak") -> bool:
    """Keep a copy of the first version of a table; False where there is one, or no table."""
    if not exists(spark, path) or exists(spark, path + suffix):
        return False
    spark.read.parquet(path).write.parquet(path + suffix)
    return True


def write_missing(df: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the table at `path` doesn't hold yet (a resumable write)."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").parquet(path)
    return spark.read.parquet(path)
