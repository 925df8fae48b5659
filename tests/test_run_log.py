"""Logs of runs that are killed and begun again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.sources import run_log


def held(spark, path, run, schema):
    return sorted(tuple(r) for r in run_log.read(spark, path, run, schema).collect())


def test_killed_and_rerun(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(100).select((F.col("id") / 2).cast("int").cast("string").alias("sample_id"), "id").repartition(4)
    dies = rows.withColumn("id", F.when(F.col("id") == 57, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))
    assert run_log.append(rows.where("id < 20"), path, "a", 0)
    with pytest.raises(Exception, match="lost"):
        run_log.append(dies, path, "a", 1)
    # the killed batch is not seen
    assert len(held(spark, path, "a", rows.schema)) == 20 and run_log.pending(rows, path, "a").count() == 80
    # begun again with all rows: samples of the first batch are not doubled, and a third time nothing happens
    assert run_log.append(rows, path, "a", 1) and not run_log.append(rows, path, "a", 1)
    assert run_log.append(rows, path, "a", 2)
    assert held(spark, path, "a", rows.schema) == sorted((str(k // 2), k) for k in range(100))
    assert run_log.pending(rows, path, "a").count() == 0
    # another run has its own
    assert held(spark, path, "b", rows.schema) == [] and run_log.append(rows.limit(0), path, "b", 0)
    assert run_log.pending(rows, path, "b").count() == 100
    with pytest.raises(ValueError):
        run_log.append(rows, path, "../a", 0)


def test_stream_delivered_again(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    spark.range(10).select(F.col("id").alias("sample_id")).write.parquet(source)

    def go(where):
        stream = spark.readStream.schema("sample_id long").parquet(source)
        q = stream.writeStream.foreachBatch(run_log.sink(path, "s")).option("checkpointLocation", str(tmp_path / where)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)

    go("one")
    go("two")  # a lost stream checkpoint delivers batch 0 again
    assert held(spark, path, "s", "sample_id long") == [(k,) for k in range(10)]
    spark.range(10, 15).select(F.col("id").alias("sample_id")).write.mode("append").parquet(source)
    go("one")
    assert held(spark, path, "s", "sample_id long") == [(k,) for k in range(15)]
