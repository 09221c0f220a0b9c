"""Session helpers that every part of the library shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def python_path(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one, a local session gets a folder of its own; a cluster, whose
    executors couldn't see it, is refused."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not at:
        at = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet; ``remove_folders`` takes it away."""
    _WRITTEN.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read again: as ``durable``, but readers take the columns they need."""
    spark, at = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def remove_folders(spark: SparkSession) -> int:
    """Remove what this process has written by ``new_folder`` and ``stored``, once their results have been used; returns
    the number of folders that were there. A session that ends without it leaves them for the folder's owner."""
    jvm, conf, gone = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than the cluster has slots, dealt evenly: one file of one row group is one task. Larger
    inputs stay as they are, so what is shuffled here is never more than a small table."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
