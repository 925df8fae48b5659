"""Cutting a plan where a table is read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the folder that spark.checkpoint.dir names; what reads it is planned from there, and a lost executor costs no recomputation.

    Spark deletes the files once df is not referenced any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set. Where no folder is
    named, a session in one process (local mode) gets a temporary one; on a cluster that is an error.
    """
    _shared(df.sparkSession)
    return df.checkpoint()


def _shared(spark: SparkSession) -> str:
    """The folder of checkpoints, which driver and executors share."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="eventloom-"))
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A new folder's name among the checkpoints."""
    return f"{_shared(spark)}/eventloom-{uuid.uuid4().hex}"
