"""What the operators of this package share: reading, spreading and cutting plans."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch handed to Python. Pages and notebooks are fat rows.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_ready(spark: SparkSession) -> None:
    """Small Arrow batches, so that a worker never holds many fat texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """Give Python stages at least as many tasks as there are cores.

    A large table already comes in more splits than there are cores and passes
    through without a shuffle; only inputs of a few splits are dealt out anew.
    """
    spark = df.sparkSession
    python_ready(spark)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset (tests on one machine) a folder is made.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or Path(tempfile.mkdtemp(prefix="siteloom-")).as_uri())
    return df.checkpoint(eager=True)
