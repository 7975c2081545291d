"""Cutting lineage and sizing input parallelism without leaving the DataFrame API."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, bench) a temporary folder is set; on a cluster
    without the setting this raises, because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint of ``df``: written to the shared folder, so a lost executor loses nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles and checkpoints that no table in use is made of any more.

    It does so only once the driver's objects for them are collected, which by itself may be after the query's end.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only a scan that has fewer partitions than the session has cores.

    Heavy Python stages over one small file would otherwise run in one task; a large input already has more splits
    than cores and passes through without a shuffle.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys)
