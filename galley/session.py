"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A scan of less than this a core (bytes as stored) is dealt out again.
SMALL = 8 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out to all cores by ``key``, if it is small.

    A row group is read by one task, so a small table in one of them would be worked on
    by one core. A table of any size worth a cluster has row groups enough and stays as
    it is read, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * SMALL else df


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to reliable storage, its lineage cut.

    The folder is the cluster's ``spark.checkpoint.dir``, which all executors
    share; only where that is unset on one machine (tests) is a temporary one used.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="galley-ckpt-"))
    return df.checkpoint(eager=True)
