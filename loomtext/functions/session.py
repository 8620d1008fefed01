"""Settings of a job that several operators need."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only on one machine (tests) a temporary folder is used where the session names none; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), "loomtext")
    return folder


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    sc = spark.sparkContext
    path = f"{shared_folder(spark).rstrip('/')}/loomtext-{sc.applicationId}"
    if path not in _made:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _made.add(path)
    return path


_made: set[str] = set()


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Unlike a cache the written table survives the loss of an executor, and unlike a local checkpoint
    it is reachable from all of them. The plan that follows starts from the files.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHUFFLE = re.compile(r"(?<!Broadcast)Exchange (?:hash|range|RoundRobin|SinglePartition)")


def spread(df: DataFrame, heavy: bool = False) -> DataFrame:
    """At least one partition per core for an expensive stage over files; inputs that already have them stay as they are.

    What comes out of a shuffle stays as it is as well, unless the stage is so ``heavy`` that one more shuffle is nothing beside it: asking for its number of
    partitions would run the shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _SHUFFLE.search(df._jdf.queryExecution().executedPlan().toString()):
        return df.repartition(max(cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))) if heavy else df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
