"""The folder that driver and executors share, and tables that replace others as a whole."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir. Where none is set: a local folder in local mode, as in tests; on
    a cluster an error, as its machines don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = f"file://{tempfile.mkdtemp(prefix='tabulon-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows written to the shared folder and read back: a lineage that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def replace_table(df: DataFrame, path: str) -> None:
    """SK7: puts df in the place of the table at path, as a whole: written beside it, then renamed. The old rows stay
    until the new ones are complete; after a failure between the two renames they are at path + '.old', from where
    `recover` takes them."""
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.old"
    df.write.parquet(fresh)
    fs, at = _fs(spark, path)
    side = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(at):
        fs.delete(side(old), True)
        if not fs.rename(at, side(old)):
            raise OSError(f"can't move {path}")
    if not fs.rename(side(fresh), at):
        fs.rename(side(old), at)
        raise OSError(f"can't move the new rows to {path}")
    fs.delete(side(old), True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back the rows that a failed replacement left beside the path; whether there were any."""
    fs, at = _fs(spark, path)
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    return bool(not fs.exists(at) and fs.exists(old) and fs.rename(old, at))
