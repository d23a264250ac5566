"""Sessions and cutting plans."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results or speed depend on; a cluster's own settings stay.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings of this library; ``master`` for runs on one machine."""
    builder = SparkSession.builder.appName("siteloom")
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def dealt(df: DataFrame) -> DataFrame:
    """At least as many tasks as cores: an input of few splits is dealt out anew, a large one passes as it is."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the checkpoint folder of the cluster and go on from there.

    A folder is made only where ``spark.checkpoint.dir`` is unset, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or Path(tempfile.mkdtemp(prefix="siteloom-")).as_uri())
    return df.checkpoint(eager=True)
