"""The index is built and searched where its blocks lie."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import block_index

from .test_block_index import corpus


def test_postings_stay_with_their_block(spark):
    docs, queries = corpus(spark, 80)
    plan = block_index.rows(docs, 4, buckets=3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(block") == 1 and "hashpartitioning(token" not in plan
    try:
        index = block_index.build(docs, "layout_of_a_test", 4, buckets=3)
        asked = F.broadcast(queries.select("query_id", F.lit(1).cast("long").alias("qn"), F.lit("w1").alias("token")))
        assert "Exchange hashpartitioning" not in block_index.bounds(index, asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE IF EXISTS layout_of_a_test")
