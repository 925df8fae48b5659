"""A log of a run's results that holds each sample once, whatever is killed and begun again.

Each batch is a folder of its own, runs/<run>/<batch>, written by the tasks and whole once Spark has put its _SUCCESS there. A batch that
was killed has none: nobody reads it, and the same batch, run again, replaces it. What is whole is never written again.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _name(part: str | int) -> str:
    if not re.fullmatch(r"[\w-]+", str(part)):
        raise ValueError(f"a run or batch is named by letters, digits, _ and -: {part!r}")
    return str(part)


def batches(spark: SparkSession, path: str, run: str) -> list[str]:
    """Folders of a run's whole batches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/runs/{_name(run)}/*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(f.getPath().getParent().toString() for f in found)


def read(spark: SparkSession, path: str, run: str, schema) -> DataFrame:
    """The rows of a run's whole batches; none, where there is none."""
    done = batches(spark, path, run)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def pending(samples: DataFrame, path: str, run: str, key: str = "sample_id") -> DataFrame:
    """samples that no whole batch of the run has: what is left to do when a run is resumed. A null key is always left."""
    spark = samples.sparkSession
    return samples.join(read(spark, path, run, samples.select(key).schema).distinct(), key, "left_anti")


def append(rows: DataFrame, path: str, run: str, batch: str | int, key: str = "sample_id") -> bool:
    """Writes the rows whose sample the run does not have yet as a batch; False, and nothing written, where that batch is whole.

    A sample may have many rows; all of them come in one batch. One writer a run at a time.
    """
    spark, folder = rows.sparkSession, f"{path}/runs/{_name(run)}/{_name(batch)}"
    if any(done.endswith(f"/{_name(run)}/{_name(batch)}") for done in batches(spark, path, run)):
        return False
    pending(rows, path, run, key).select(*rows.columns).write.mode("overwrite").parquet(folder)
    return True


def sink(path: str, run: str, key: str = "sample_id"):
    """For writeStream.foreachBatch: a micro-batch that is delivered again is written once."""
    return lambda rows, batch: append(rows, path, run, batch, key) and None
