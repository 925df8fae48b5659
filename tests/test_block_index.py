"""Retrieval from the persisted index gives what retrieval over the documents gives, and reads a part of the postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from eventloom.operators import block_index, metrics, retrieval, steps

R = random.Random(5)


def corpus(spark, n=300):
    words = [f"w{k}" for k in range(400)]

    def text(low, high):
        return " ".join(words[int(400 * R.random() ** 2)] for _ in range(R.randint(low, high)))

    rows = [(k, k % 90, R.choice([None, "", text(1, 8)]), R.choice([text(0, 12), text(50, 90), text(200, 300)])) for k in range(n)]
    rows += [(n + k, 500 + k, "same title here", "w1 w2 w3 same text") for k in range(30)] + [(900, 1000, None, None)]  # ties
    docs = spark.createDataFrame(rows, "document_id long, ord long, title string, text string").withColumn("token", F.lit(1))
    asked = [(k, text(3, 20)) for k in range(12)] + [(50, "same title here w1"), (51, "nothing known"), (52, ""), (53, None), (54, rows[5][3])]
    return docs, spark.createDataFrame(asked, "query_id long, text string")


@pytest.mark.parametrize(("block", "first", "most"), [(8, 8, 6), (1, 1, 3), (1000, 1, 6), (4, 2, 1)])
def test_same_answers(spark, block, first, most):
    docs, queries = corpus(spark)
    index = block_index.rows(docs, block)
    best, report = block_index.search(index, queries, most, first_blocks=first)
    cols = ["query_id", "document_id", "ord", "rank", F.round("score", 12).alias("score"), "matched_terms"]
    assert sorted(best.select(*cols).collect()) == sorted(retrieval.retrieve(queries, docs, most).select(*cols).collect())
    read = report.agg(F.sum("postings"), F.sum("read")).first()
    assert read[1] <= read[0] and (block != 4 or read[1] < 0.6 * read[0])


def test_persisted(spark):
    docs, queries = corpus(spark, 60)
    try:
        block_index.build(docs, "index_of_a_test", 4, buckets=3)
        index = block_index.opened(spark, "index_of_a_test")
        best = block_index.search(index, queries)[0]
        assert best.count() == retrieval.retrieve(queries, docs).count()
        plan = block_index.bounds(index, queries.select("query_id", F.lit(1).cast("long").alias("qn"), F.lit("w1").alias("token")).hint("merge"))._jdf.queryExecution().executedPlan().toString()
        assert "documents" not in plan.split("ReadSchema")[1][:200]  # bounds are read without postings
        assert block_index.search(block_index.rows(docs.limit(0)), queries)[0].count() == 0
        assert block_index.search(index, queries.limit(0))[0].count() == 0
    finally:
        spark.sql("DROP TABLE IF EXISTS index_of_a_test")


def test_evaluation_reads_little(spark):
    """Six scans and twelve exchanges at most; no rows give zeros."""
    edges = steps.cut(spark.createDataFrame([("s", "a", "b", "causes", 1, 0.9, 0.8), ("s", "b", "c", "precedes", 2, 0.4, 0.2)], "sample_id string, source string, target string, relation_type string, ord int, score double, keep_probability double"))
    got = metrics.evaluation(edges, edges, edges.where("score > 0.5"), edges, edges.where("ord = 1"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") <= 6 and plan.count("Exchange ") <= 12
    value = {r.metric: r.value for r in got.collect()}
    assert len(value) == 68 and value["dataset.gold_edges"] == value["coarse.candidate_pairs"] == 2 and value["coarse.graph_labeled.recall"] == 0.5
    assert value["coarse.pair_classification_raw.accuracy"] == 1 and value["coarse.pair_classification_thresholded.correct"] == 1 and value["refinement.keep_binary.fn"] == 1
    none = {r.metric: r.value for r in metrics.evaluation(*[edges.limit(0)] * 5).collect()}
    assert set(none) == set(value) and not any(none.values())
