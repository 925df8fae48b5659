"""The driver's tables as events, documents and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as X

QUERY = "Which purchase follows an error on this item?"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample is a user, a document one of their weeks, an event a row of events; its place in the week is the sentence index."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    week = F.floor((F.dayofyear("ts") - 1) / 7).cast("int")
    doc = F.concat(F.lit("u"), "user_id", F.lit("w"), week)
    mention = F.concat("event_type", F.lit(" item "), "k")
    rows = e.select(
        F.col("user_id").alias("sample_id"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_id"), F.col("event_id").alias("ord"), doc.alias("document_id"), "ts", "event_id",
        F.col("event_type").alias("trigger"), mention.alias("mention"), F.array(F.concat(F.lit("p"), F.col("k") % 7)).alias("participants"),
        F.date_format("ts", "yyyy-MM-dd").alias("publish_time"), (F.col("value") / 500.0).alias("confidence"), X.event_mention(F.col("event_type"), mention).alias("text"),
        F.lit("observed").alias("node_type"), F.lit(False).alias("is_title"),
    ).toDF("sample_id", "event_id", "ord", "document_id", "ts", "row_id", "trigger", "mention", "participants", "publish_time", "confidence", "text", "node_type", "is_title")
    place = F.row_number().over(Window.partitionBy("sample_id", "document_id").orderBy("ts", "row_id")) - 1
    return rows.withColumn("sentence_index", place).drop("ts", "row_id")


def news_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the first line's first sentence as title."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    first = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("ord"), F.element_at(F.split(first, r"[.!?]"), 1).alias("title"), "text", "source")


def item_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
