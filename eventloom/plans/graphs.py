"""Whole plans: documents to local graphs, events to coarse graphs, coarse to refined graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import DEFAULT, Lexicon
from ..operators import features, graph, pairs, retrieval, sampling, steps
from .scorers import GraphRefiner, PairScorer, extractor, heuristic_scorer, with_prior


def local_graph(queries: DataFrame, docs: DataFrame, max_docs: int = 6, max_events_per_doc: int = 4, extractor_name: str = "rule", lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """queries (query_id, text, and focus_entities, if there are any), docs (document_id, ord, title, text) → (events, edges) by retrieval, extraction,
    order in the documents, and events supposed between those that share an entity of the query."""
    hits = retrieval.retrieve(queries, docs, max_docs, lexicon=lexicon)
    found = hits.select("query_id", "document_id", "rank").join(docs.drop("ord"), "document_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    events = extractor(extractor_name)(found, max_events_per_doc, lexicon=lexicon).withColumnRenamed("query_id", "sample_id")
    events = events.withColumn("node_type", F.lit("observed")).withColumn("document_id", F.col("document_id").cast("string"))
    events = steps.cut(events)  # of a few documents a query; edges, bridges and both results read them
    edges = graph.neighbour_edges(events).withColumn("is_hypothesis", F.lit(False))
    named = F.col("focus_entities") if "focus_entities" in queries.columns else F.array().cast("array<string>")
    focus = queries.select(F.col("query_id").alias("sample_id"), F.when(F.size(named) > 0, named).otherwise(X.titlecase_entities(F.col("text"))).alias("focus"))
    more_events, more_edges = bridges(events, edges, focus, lexicon)
    return events.unionByName(more_events, allowMissingColumns=True), edges.unionByName(more_edges, allowMissingColumns=True)


def bridges(events: DataFrame, edges: DataFrame, focus: DataFrame, lexicon: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(events, edges) supposed between pairs of events, at most two a sample: each enabled by the first and causing the second.

    Ids go on where those of the sample's events and edges end; focus (sample_id, focus) are the entities that a pair must share.
    """
    rows = events.join(focus, "sample_id")
    # in a sample's list events stand by document, then sentence
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy("rank", "sentence_index", "ord"))
    pairs_found = pairs.bridge_pairs(rows.withColumn("_at", place).withColumn("_ord", F.col("ord")).withColumn("ord", F.col("_at")), F.col("focus"))
    counted = events.groupBy("sample_id").agg(F.count("*").alias("_n"))
    linked = edges.groupBy("sample_id").agg(F.count("*").alias("_m"))
    b = pairs_found.join(counted, "sample_id").join(linked, "sample_id", "left").withColumn("_m", F.coalesce("_m", F.lit(0)))
    b = b.withColumn("event_id", F.concat(F.lit("e"), F.col("_n") + F.col("pair_rank") - 1))
    shared = F.array_sort(F.array_intersect("s_participants", "t_participants"))
    more = b.select(
        "sample_id", "event_id", (F.col("_n") + F.col("pair_rank") - 1).cast("int").alias("ord"), F.lit("bridge").alias("document_id"), F.lit(0).alias("sentence_index"), F.col("bridge_text").alias("text"),
        X.normalize(F.col("bridge_text"), lexicon).alias("normalized_text"), shared.alias("participants"), F.lit(0.38).alias("confidence"), F.lit("bridge_hypothesis").alias("node_type"), F.lit("").alias("trigger"),
    )
    at = F.col("_m") + 2 * (F.col("pair_rank") - 1)

    def edge(k: int, source: str, target: str, kind: str) -> DataFrame:
        return b.select("sample_id", F.concat(F.lit("edge"), at + k).alias("edge_id"), F.lit("bridge").alias("document_id"), F.col(source).alias("source"), F.col(target).alias("target"), F.lit(kind).alias("relation_type"), F.lit(0.4).alias("score"), (at + k).cast("int").alias("ord"), F.lit(True).alias("is_hypothesis"))

    return more, edge(0, "s_event_id", "event_id", "enables").unionByName(edge(1, "event_id", "t_event_id", "causes"))


def inference_sample(queries: DataFrame, docs: DataFrame, max_docs: int = 6, max_events_per_doc: int = 6, max_events: int = 0, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The events that a coarse graph is made of, from documents: those of the local graph, cut to max_events."""
    return graph.truncate_events(local_graph(queries, docs, max_docs, max_events_per_doc, lexicon=lexicon)[0], max_events)


def news_samples(queries: DataFrame, news: DataFrame, prefix: str = "mirai_", **more) -> DataFrame:
    """Inference samples of query rows (corpora.queries) over the news that each names; a document belongs to the queries that name it."""
    told = retrieval.news_for_ids(queries, news).select("query_id", "document_id", F.col("pos").alias("ord"), "title", "text")
    own = told.select(F.concat_ws("\x1f", "query_id", "document_id").alias("document_id"), F.col("query_id").alias("owner"), "ord", "title", "text")
    rows = retrieval.retrieve_own(queries, own, more.get("max_docs", 6))
    events = retrieval.document_events(rows, more.get("max_events_per_doc", 6))
    events = events.withColumn("document_id", F.substring_index("document_id", "\x1f", -1)).withColumnRenamed("query_id", "sample_id").withColumn("sample_id", F.concat(F.lit(prefix), "sample_id"))
    return graph.truncate_events(events, more.get("max_events", 0))


def coarse_graph(events: DataFrame, query, scorer: PairScorer | None = None, max_events: int = 16, max_gap: int = 3, max_pairs: int = 64, threshold: float = 0.5, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Events → typed edges: sparse candidate pairs, a scorer, and a threshold."""
    rows = pairs.with_tokens(graph.truncate_events(events, max_events), query, lexicon)
    scored = (scorer or heuristic_scorer(lexicon))(pairs.inference_pairs(rows, max_gap, max_pairs, indexed=max_events <= 0))
    named = scored.select("sample_id", "pair_rank", F.col("s_event_id").alias("source"), F.col("t_event_id").alias("target"), "relation_type", "score")
    return graph.graph_from_predictions(named, threshold)


def candidates(events: DataFrame, edges: DataFrame, query, completions: int = 64) -> DataFrame:
    """Coarse edges plus the best pairs that they lack, as candidates for a refiner. events carry tokens and times (features.event_times)."""
    forbidden = edges.select("sample_id", F.col("source").alias("s_event_id"), F.col("target").alias("t_event_id"))
    more = pairs.completion_pairs(events, forbidden, query, completions)
    extra = features.completion_edges(more).select("sample_id", "source", "target", "relation_type", "score", "source_kind", (F.col("ord") + 1_000_000).alias("ord")).withColumn("edge_id", F.lit(None).cast("string"))
    return edges.select("sample_id", "source", "target", "relation_type", "score", F.lit("coarse").alias("source_kind"), "ord", "edge_id").unionByName(extra)


def refine(events: DataFrame, edges: DataFrame, query, refiner: GraphRefiner | None = None, threshold: float = 0.5, completions: int = 64) -> DataFrame:
    """Coarse edges plus completion candidates (all, if completions is 0) → the refined graph."""
    rows = candidates(events, edges, query, completions)
    if refiner is None:
        return graph.graph_of_actions(graph.scored_actions(with_prior(rows), threshold))
    rows = steps.cut(rows)  # read by the refiner and for its actions
    return graph.refined_graph(rows, refiner(rows), threshold)


def completion_candidates(gold: DataFrame, coarse: DataFrame, events: DataFrame, query, negative_ratio: float = 0.75, most: int = 0, seed: int = 7) -> DataFrame:
    """Coarse edges plus completion candidates to train a refiner on: the gold pairs that the coarse graph lacks, in hash order, then the best
    ranked pairs of neither graph, max(1, ratio x gold pairs) of them; at most `most` in all, if that is over 0; equal edges once.

    events carry tokens and times (features.event_times). (sample_id, ord, source, target, relation_type, score, source_kind, edge_id)
    """
    keys = ["sample_id", "source", "target"]
    wanted, have = (e.select("sample_id", F.col("source").alias("s_event_id"), F.col("target").alias("t_event_id")) for e in (gold, coarse))
    both = pairs.training_completions(events, wanted, have, query, negative_ratio, seed)
    both = both.withColumn("pair_rank", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("told"), "place")))
    both = both.where(F.col("pair_rank") <= most) if most > 0 else both
    name = F.concat(F.when(F.col("told"), "completion_gold_").otherwise("completion_neg_"), F.col("pair_rank") - 1)
    extra = features.completion_edges(both.withColumn("edge_id", name), "edge_id")
    old = coarse.select(*keys, "relation_type", "score", F.lit("coarse").alias("source_kind"), "ord", F.coalesce("edge_id", F.lit(None).cast("string")).alias("edge_id") if "edge_id" in coarse.columns else F.lit(None).cast("string").alias("edge_id"))
    new = extra.select(*keys, "relation_type", "score", "source_kind", (F.col("ord") + 1_000_000).alias("ord"), "edge_id")
    return graph.dedupe_edges(old.unionByName(new))


def refinement_samples(gold_events: DataFrame, gold_edges: DataFrame, query, cutoff, negative_ratio: float = 0.75, most: int = 0, seed: int = 7) -> dict[str, DataFrame]:
    """Training samples of a refiner from gold graphs: a coarse graph is drawn from each, completed, and labelled by the gold edges.

    → tables nodes (10 features), edges (20), queries (6) and labels, all by sample_id. Samples under two events or without an edge are left out.
    What the tables share (events, the drawn graph, the candidates) is cut (steps.cut), so that it is planned and run once.
    """
    fit = gold_events.groupBy("sample_id").count().where("count >= 2").join(gold_edges.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id")
    events = steps.cut(features.event_times(pairs.with_tokens(gold_events.join(fit, "sample_id", "left_semi"), query), cutoff))
    gold = steps.cut(gold_edges.join(fit, "sample_id", "left_semi"))
    everything = pairs.inference_pairs(events, max_gap=1_000_000, max_pairs=0).select("sample_id", F.col("s_event_id").alias("source"), F.col("t_event_id").alias("target"))
    coarse = sampling.perturb(gold, everything, seed)
    coarse = steps.cut(coarse.withColumn("ord", F.row_number().over(Window.partitionBy("sample_id").orderBy("source", "target", "relation_type"))))
    rows = steps.cut(completion_candidates(gold, coarse, events, query, negative_ratio, most, seed))
    return {
        "nodes": features.node_features(events, query), "edges": features.edge_features(rows, events), "queries": features.query_features(events, rows, F.lit(0)),
        "labels": features.labelled_samples(rows.select("sample_id", "ord", "source", "target", "source_kind"), gold),
    }


def rank_frontier(events: DataFrame, scores: DataFrame, most: int = 10) -> DataFrame:
    """Events of each sample by a refiner's score (sample_id, event_id, frontier_score), rounded; ties in the order of the events."""
    scored = events.select("sample_id", "event_id", "ord", "text").join(scores, ["sample_id", "event_id"]).withColumn("frontier_score", F.round("frontier_score", 4))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("frontier_score"), "ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("sample_id", "rank", "event_id", "text", "frontier_score")


def frontier(refined: DataFrame, most: int = 10) -> DataFrame:
    """Nodes by their share of the sample's outgoing edges: for a graph without a refiner's scores of nodes (rank_frontier())."""
    out = graph.endpoints(refined).groupBy("sample_id", "event_id").agg(F.sum("out").alias("out"))
    w = Window.partitionBy("sample_id")
    scored = out.withColumn("frontier_score", F.round(F.col("out") / F.greatest(F.sum("out").over(w), F.lit(1)), 4))
    rank = F.row_number().over(w.orderBy(F.desc("frontier_score"), "event_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("sample_id", "rank", "event_id", "frontier_score")
