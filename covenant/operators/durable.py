"""Lineage cuts for iterative operators, in the folder all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where unset (one machine) a temporary folder."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if conf is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster a folder that all executors share is needed")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="covenant-"))
        current = sc._jsc.sc().getCheckpointDir()
    return conf or current.get()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives lost executors and is cleaned up by Spark."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
