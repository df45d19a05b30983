"""Session helpers: table access and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark resolves the path, so any Hadoop store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a fresh local one only where it is unset and driver and executors are one
    process, as in tests. On a cluster an unset folder is an error: executors would write where no one else reads."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared root. It goes when the driver ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(hadoop)

    def drop() -> None:
        if path.startswith("file:"):
            shutil.rmtree(local(path), ignore_errors=True)

    atexit.register(drop)
    return path


def local(path: str) -> str:
    """A ``file:`` URI as a plain path."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back: it cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(name: str, *taken: DataFrame) -> str:
    """``name``, with underscores before it until no table has such a column (names differ by more than case)."""
    used = {c.lower() for df in taken for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def keyed(df: DataFrame, name: str) -> DataFrame:
    """The table with a row number in a further column ``name``, written so that it stays the same in every read."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["table", "shared_root", "scratch", "local", "materialise", "free_name", "keyed", "shuffle_width"]
