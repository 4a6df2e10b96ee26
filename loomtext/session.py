"""Session helpers shared by all operators: tables, parallelism and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the input directory (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)


#: Bytes a task should have before a stage is spread over the cores.
TASK_BYTES = 64 << 20


def spread(df: DataFrame, factor: int = 1) -> DataFrame:
    """Repartition only if there are fewer partitions than cores.

    A single small file is read by one task, and small shuffles are coalesced to one; CPU-bound
    Python stages behind them would then use one core. Large inputs already have more partitions than
    cores and pass through without a shuffle. Nothing is executed to find out.
    """
    spark = df.sparkSession
    want = parallelism(spark) * factor
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        few = int(str(plan.optimizedPlan().stats().sizeInBytes())) < want * TASK_BYTES
    else:
        few = plan.toRdd().getNumPartitions() < want
    return df.repartition(want) if few else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's spark.checkpoint.dir. Only on one machine,
    as in tests, a temporary folder takes its place where it is unset."""
    conf = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not conf:
        conf = spark.conf.get("loomtext.checkpoint.dir", "")
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        conf = tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("loomtext.checkpoint.dir", conf)
    return conf


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Bound the rows of one Arrow batch, so that long texts do not pile up in a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def file_system(root: str):
    """(file system, folder) of a root with or without a scheme: local disks, HDFS and object stores alike."""
    from pyarrow import fs

    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/*(?=/)", "file://", root))
    return fs.LocalFileSystem(), os.path.abspath(root)
