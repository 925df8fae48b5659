"""Retrieval from a persisted inverted index with bounds: the same answers as retrieval.retrieve, from few of the postings.

Documents are put into blocks of like length. A row of the index is a token in a block: the documents there that have it, and the smallest sizes among
them. Table and rows are laid out so that a search moves as little as it can: bucketed by block, so that building shuffles documents, not postings, and a search
that sends the queries' tokens out bounds and scores a block where it lies; bounds in columns of their own, so that they are read without the postings; a token of
very many documents is as many rows as blocks.

A search first bounds the score of every block by the query's tokens in it. The likeliest blocks give scores, the best of them a floor for each query;
of the other blocks only those are read whose bound reaches the floor. Jaccard similarity falls with length, so blocks of long documents mostly drop out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import DEFAULT, Lexicon
from . import retrieval, steps

BLOCK_DOCUMENTS, BUCKETS, FIRST_BLOCKS = 8, 16, 8
#: documents in a bucket, where there are more than these buckets hold
BUCKET_DOCUMENTS = 5_000
#: bands of length of text and title: so many between a size and its double
BANDS, TITLE_BANDS = 4, 2


def _band(tokens: str, parts: int) -> Column:
    return F.floor(F.log2(F.size(tokens) + F.lit(1.0)) * parts).cast("long")


def rows(docs: DataFrame, block_documents: int = BLOCK_DOCUMENTS, lexicon: Lexicon = DEFAULT, buckets: int = 0) -> DataFrame:
    """docs (document_id, ord, title, text) → token, block, n, title_size, body_size (smallest of a document that has the token there; null without one), documents.

    With buckets, documents are dealt by block before they are taken apart, and the rows stay where they are.
    """
    d = docs.select("document_id", "ord", *[F.array_distinct(X.content_tokens(F.coalesce(c, F.lit("")), lexicon)).alias(n) for c, n in (("title", "tt"), ("text", "bt"))])
    d = d.select("*", F.size("tt").alias("tn"), F.size("bt").alias("bn"), _band("bt", BANDS).alias("band"), _band("tt", TITLE_BANDS).alias("title_band"))
    bands = d.groupBy("band", "title_band").agg(F.ceil(F.count("*") / block_documents).alias("blocks"))
    d = d.join(F.broadcast(bands), ["band", "title_band"])  # at most some thousands of bands, by the doubling of lengths
    block = (F.col("band") * 256 + F.col("title_band")) * (1 << 40) + F.pmod(F.xxhash64("document_id"), F.col("blocks"))
    d = d.select("document_id", "ord", "tn", "bn", block.alias("block"), "tt", "bt")
    d = d.repartition(buckets, "block") if buckets else d
    each = d.select("*", F.explode(F.array_union("tt", "bt")).alias("token"))
    each = each.select("token", "block", "document_id", "ord", "tn", "bn", F.array_contains("tt", F.col("token")).alias("t"), F.array_contains("bt", F.col("token")).alias("b"))
    return each.groupBy("token", "block").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("t"), F.col("tn"))).alias("title_size"), F.min(F.when(F.col("b"), F.col("bn"))).alias("body_size"),
        F.collect_list(F.struct("document_id", "ord", "tn", "bn", "t", "b")).alias("documents"),
    )


def build(docs: DataFrame, name: str, block_documents: int = BLOCK_DOCUMENTS, buckets: int = 0, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The index of docs as a table of the warehouse; as many buckets as the documents need, unless told."""
    buckets = buckets or max(BUCKETS, -(-docs.count() // BUCKET_DOCUMENTS))
    out = rows(docs, block_documents, lexicon, buckets)
    out.write.bucketBy(buckets, "block").sortBy("token", "block").format("parquet").mode("overwrite").saveAsTable(name)
    return opened(docs.sparkSession, name)


def opened(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def _most(asked: Column, matched: Column, smallest: Column) -> Column:
    """The largest Jaccard similarity of a document of at least the smallest size with at most so many of the asked tokens."""
    return F.when(matched > 0, matched / (asked + F.greatest(smallest, matched) - matched)).otherwise(0.0)


def bounds(index: DataFrame, asked: DataFrame, title_weight: float = 1.4) -> DataFrame:
    """(query_id, block, postings, most): what a block's best document can score at most. Reads no posting."""
    met = index.select("token", "block", "n", "title_size", "body_size").join(asked, "token")
    found = met.groupBy("query_id", "qn", "block").agg(F.sum("n").alias("postings"), F.count("title_size").alias("nt"), F.count("body_size").alias("nb"), F.min("title_size").alias("tn"), F.min("body_size").alias("bn"))
    most = title_weight * _most(F.col("qn"), F.col("nt"), F.col("tn")) + _most(F.col("qn"), F.col("nb"), F.col("bn"))
    return found.select("query_id", "block", "postings", most.alias("most"))


def _met(index: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """The postings of the blocks (query_id, block) of each query. Blocks go to where the index has them; which queries want one is looked up there."""
    chosen = blocks.groupBy("block").agg(F.collect_list("query_id").alias("_queries"))
    met = index.select("token", "block", "documents").join(chosen.hint("shuffle_hash"), "block").join(asked, "token").where(F.array_contains("_queries", F.col("query_id")))
    return met.select("query_id", "qn", "token", "block", F.explode("documents").alias("d")).select("query_id", "qn", "token", "block", "d.*")


def _scored(index: DataFrame, asked: DataFrame, blocks: DataFrame, title_weight: float) -> DataFrame:
    """(query_id, block, document_id, ord, score) of the documents of the blocks (query_id, block) of each query."""
    found = _met(index, asked, blocks).groupBy("block", "query_id", "document_id", "ord", "qn", "tn", "bn").agg(F.count_if("t").alias("nt"), F.count_if("b").alias("nb"))
    score = title_weight * retrieval.jaccard_of(F.col("nt"), F.col("qn"), F.col("tn")) + retrieval.jaccard_of(F.col("nb"), F.col("qn"), F.col("bn"))
    return found.select("query_id", "block", "document_id", "ord", score.alias("score"))


def search(index: DataFrame, queries: DataFrame, max_docs: int = 6, title_weight: float = 1.4, first_blocks: int = FIRST_BLOCKS, lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, text) → (the best documents of each as retrieval.retrieve has them, (query_id, postings, read) of what was looked at).

    A query without a known token has no row in either; a block with a bound equal to the floor is read, as ties go by ord.
    """
    q = queries.select("query_id", X.token_set(F.col("text"), lexicon).alias("qt"))
    asked = steps.cut(q.select("query_id", F.size("qt").cast("long").alias("qn"), F.explode("qt").alias("token")))
    asked = F.broadcast(asked) if asked.count() <= retrieval.SENT_TOKENS else asked
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "block"))
    blocks = steps.cut(bounds(index, asked, title_weight).withColumn("place", place))
    first = steps.cut(_scored(index, asked, blocks.where(F.col("place") <= first_blocks), title_weight))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    floor = first.withColumn("_k", rank).where(F.col("_k") == max_docs).select("query_id", F.col("score").alias("floor"))
    later = blocks.where(F.col("place") > first_blocks).join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("most") + 1e-9 >= F.col("floor")))
    later = steps.cut(later.select("query_id", "block", "postings"))
    every = first.unionByName(_scored(index, asked, later, title_weight))
    best = steps.cut(every.withColumn("rank", rank).where(F.col("rank") <= max_docs))
    # matched terms are looked up for the best documents only
    of = ["query_id", "block", "document_id"]
    terms = _met(index, asked, best.select("query_id", "block").distinct()).join(F.broadcast(best.select(*of)), of, "left_semi").groupBy(*of).agg(F.array_sort(F.collect_list("token")).alias("matched_terms"))
    best = best.join(terms, of)
    read = blocks.where(F.col("place") <= first_blocks).select("query_id", "block", "postings").unionByName(later).groupBy("query_id").agg(F.sum("postings").alias("read"))
    report = blocks.groupBy("query_id").agg(F.sum("postings").alias("postings")).join(read, "query_id")
    return best.select("query_id", "document_id", "ord", "score", "matched_terms", "rank"), report
