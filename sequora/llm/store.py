"""Shared storage for cut lineage: tables written under ``spark.checkpoint.dir`` and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Only where that is unset (tests, local mode) a temporary
    folder is made and noted in the session, so that later calls use the same one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("sequora.local.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("sequora.local.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of an Arrow batch between the JVM and Python: with it, what a task holds does not grow with the length of texts.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; sees to it that the session sends Python batches of ``BATCH_BYTES`` at most (or one row), and merges small shuffle partitions by their size alone."""
    conf, merge = df.sparkSession.conf, "spark.sql.adaptive.coalescePartitions"
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b"), (f"{merge}.parallelismFirst", "false"), (f"{merge}.minPartitionNum", "2")):
        if conf.get(key, None) != value:
            conf.set(key, value)
    return df


def cut(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: its lineage ends there.

    Nobody looks for the marker of success, as the path is only known once the write has ended well. ``files`` bounds the files (and tasks) of a
    table that is known to be small.
    """
    spark = small_batches(df).sparkSession
    path, schema = fresh_path(spark, name), df.schema
    held = df.coalesce(files) if files else df
    held.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
