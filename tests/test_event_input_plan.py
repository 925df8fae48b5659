"""A record is parsed once, whatever is asked of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom import queries
from eventloom.sources import event_input

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_on_errors_parses_nothing_again(spark):
    raw = spark.createDataFrame([(0, '{"events": []}'), (1, None)], "ord int, json string").localCheckpoint()
    told = plan(event_input.validate(raw).where(F.size("errors") == 0).select("ord", "query_id", F.size("events")))
    assert told.count("parseJson") == 1


def test_the_summary_reads_its_records_once(spark):
    told = plan(queries.event_input_summary(spark, DATA))
    assert "LogicalRDD" in told and "parquet" not in told
