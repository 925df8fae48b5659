"""Typed event graphs: events and edges as tables keyed by sample_id. Edges: source, target, relation_type, score, ord."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import LOCAL_MARKERS, PRIORITY
from ..functions.values import field, is_object, json_answer, words
from . import steps


def truncate_events(events: DataFrame, most: int) -> DataFrame:
    """The most events of each sample with the highest confidence, ties by sentence and id; their order stays."""
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("confidence"), "sentence_index", "event_id"))
    return events.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank") if most > 0 else events


def dedupe_edges(edges: DataFrame, keys: tuple[str, ...] = ("source", "target", "relation_type")) -> DataFrame:
    """First edge of each key by ord."""
    rank = F.row_number().over(Window.partitionBy("sample_id", *keys).orderBy("ord"))
    return edges.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def neighbour_edges(events: DataFrame, markers: list[str] = LOCAL_MARKERS) -> DataFrame:
    """An edge from each event to the next of its document; a second, causal one where the pair's words hold a marker.

    Ids run over a sample: documents by their rank (where events have one, else by id), in each the temporal edges, then the causal ones.
    """
    place = "rank" if "rank" in events.columns else "document_id"
    w = Window.partitionBy("sample_id", "document_id").orderBy("sentence_index", "ord")
    named = events.select("sample_id", "document_id", F.col(place).alias("_place"), "sentence_index", "ord", F.col("event_id").alias("source"), F.lead("event_id").over(w).alias("target"), "text", F.lead("text").over(w).alias("next_text"))
    pairs = named.where("target is not null").withColumn("causal", X.has_marker(F.concat_ws(" ", "text", "next_text"), markers))
    kinds = F.when(F.col("causal"), F.array(F.lit("precedes"), F.lit("causes"))).otherwise(F.array(F.lit("precedes")))
    edges = pairs.select("sample_id", "document_id", "_place", "sentence_index", F.col("ord").alias("_ord"), "source", "target", F.posexplode(kinds).alias("block", "relation_type"))
    score = F.when(F.col("relation_type") == "causes", 0.72).otherwise(0.55)
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy("_place", "block", "sentence_index", "_ord")) - 1
    return edges.select("sample_id", F.concat(F.lit("edge"), rank).alias("edge_id"), "document_id", "source", "target", "relation_type", score.alias("score"), rank.alias("ord"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("sample_id", F.explode(F.array(F.struct(F.col("source").alias("event_id"), F.lit(1).alias("out")), F.struct(F.col("target").alias("event_id"), F.lit(0).alias("out")))).alias("p")).select("sample_id", "p.*")


def degrees(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, event_id, out_degree, in_degree, degree) of every event, zeros included."""
    told = endpoints(edges).groupBy("sample_id", "event_id").agg(F.sum("out").alias("out_degree"), F.sum(1 - F.col("out")).alias("in_degree"))
    out, into = (F.coalesce(c, F.lit(0)).cast("long") for c in ("out_degree", "in_degree"))
    return events.select("sample_id", "event_id").join(told, ["sample_id", "event_id"], "left").select("sample_id", "event_id", out.alias("out_degree"), into.alias("in_degree"), (out + into).alias("degree"))


def truncate_graph(events: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Ends of the best edges first, then the best connected events, up to most a sample; and the edges among them.

    The greedy walk over sorted edges is a rank: an event comes where it first appears as an end.
    """
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "ord"))
    ranked = edges.withColumn("_r", rank)
    ends = ranked.select("sample_id", F.explode(F.array(F.struct((2 * F.col("_r")).alias("at"), F.col("source").alias("event_id")), F.struct((2 * F.col("_r") + 1).alias("at"), F.col("target").alias("event_id")))).alias("p"))
    first = ends.select("sample_id", "p.*").groupBy("sample_id", "event_id").agg(F.min("at").alias("at"))
    rows = events.join(degrees(events, edges).select("sample_id", "event_id", "degree"), ["sample_id", "event_id"]).join(first, ["sample_id", "event_id"], "left")
    order = Window.partitionBy("sample_id").orderBy(F.asc_nulls_last("at"), F.desc("degree"), F.desc("confidence"), "sentence_index", "event_id")
    kept = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select(*events.columns)
    ids = kept.select("sample_id", "event_id")
    inside = edges.join(ids.withColumnRenamed("event_id", "source"), ["sample_id", "source"], "left_semi").join(ids.withColumnRenamed("event_id", "target"), ["sample_id", "target"], "left_semi")
    return kept, dedupe_edges(inside.select(*edges.columns))


def label_order() -> Column:
    """What edges of a pair are ranked by: the priority of their relation, then the first."""
    priority = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("relation_type")), F.lit(0))
    return F.struct(priority.cast("int").alias("priority"), (-F.col("ord")).cast("long").alias("place"))


def pair_labels(edges: DataFrame) -> DataFrame:
    """(sample_id, source, target, label): the relation with the highest priority, of equals the first."""
    return edges.groupBy("sample_id", "source", "target").agg(F.max_by("relation_type", label_order()).alias("label"))


def last_labels(edges: DataFrame) -> DataFrame:
    """The same, where the last edge of a pair wins."""
    return edges.groupBy("sample_id", "source", "target").agg(F.max_by("relation_type", "ord").alias("label"))


def graph_from_predictions(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Edges of scored pairs (sample_id, pair_rank, source, target, relation_type, score): known relations at or over the threshold.

    The id is the place among all pairs, so numbers may be missing.
    """
    fine = pairs.where(F.col("relation_type").isin(*PRIORITY) & (F.col("score") >= threshold))
    return dedupe_edges(fine.select("sample_id", F.concat(F.lit("pred_edge_"), F.col("pair_rank") - 1).alias("edge_id"), "source", "target", "relation_type", "score", F.col("pair_rank").alias("ord")))


def edge_actions(candidates: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Every candidate with what the refiner (sample_id, ord, keep_probability, relation_type, strength) makes of it.

    KEEP or DROP where it was in the graph, ADD or REJECT where it is a completion (source_kind, or no edge_id).
    """
    return scored_actions(candidates.drop("relation_type", "score").join(scores, ["sample_id", "ord"]), threshold)


def scored_actions(met: DataFrame, threshold: float = 0.5) -> DataFrame:
    """edge_actions of candidates that have the refiner's columns in their rows."""
    new = F.col("source_kind") == "completion" if "source_kind" in met.columns else F.col("edge_id").isNull()
    kept = F.col("keep_probability") >= threshold
    action = F.when(new & kept, "ADD").when(new, "REJECT").when(kept, "KEEP").otherwise("DROP")
    return met.withColumn("action", action)


def refined_graph(candidates: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Candidates (sample_id, ord, source, target, edge_id or null for added ones) with a refiner's (sample_id, ord, keep_probability, relation_type, strength).

    A column metadata (map) of the candidates is kept, with the refiner's numbers added.
    """
    return graph_of_actions(edge_actions(candidates, scores, threshold))


def graph_of_actions(actions: DataFrame) -> DataFrame:
    """The refined graph of edge_actions or scored_actions: what is kept or added."""
    met = actions.where("action in ('KEEP', 'ADD')")
    added = F.concat(F.lit("refined_added_edge_"), F.col("ord").cast("string"))
    more = F.create_map(F.lit("keep_probability"), F.round("keep_probability", 4).cast("string"), F.lit("action"), F.col("action"))
    told = [F.map_concat(F.map_filter(F.coalesce("metadata", more), lambda k, v: ~k.isin("keep_probability", "action")), more).alias("metadata")] if "metadata" in actions.columns else []
    return met.select("sample_id", F.coalesce("edge_id", added).alias("edge_id"), "source", "target", "relation_type", F.round("strength", 4).alias("score"), F.round("keep_probability", 4).alias("keep_probability"), "action", "ord", *told)


def edge_preview(candidates: DataFrame, scores: DataFrame, events: DataFrame) -> DataFrame:
    """What a refiner says of each candidate, with the texts of its ends, in order."""
    text = events.select("sample_id", "event_id", "text")
    told = scores.select("sample_id", "ord", F.round("keep_probability", 4).alias("keep_probability"), F.col("relation_type").alias("predicted_type"), F.round("strength", 4).alias("strength"))
    kind = F.col("source_kind") if "source_kind" in candidates.columns else F.lit("coarse")
    out = candidates.withColumn("candidate_kind", kind).join(told, ["sample_id", "ord"])
    out = out.join(text.toDF("sample_id", "source", "source_text"), ["sample_id", "source"], "left").join(text.toDF("sample_id", "target", "target_text"), ["sample_id", "target"], "left")
    return out.select("sample_id", "ord", "source", "target", "source_text", "target_text", "candidate_kind", F.col("relation_type").alias("coarse_type"), "predicted_type", F.col("score").alias("coarse_score"), "strength", "keep_probability")


def ids(rows: DataFrame, column: str) -> DataFrame:
    """(sample_id, id): the distinct ids of events, edges or trace events that are not blank."""
    return rows.select("sample_id", F.trim(column).alias("id")).where("id <> ''").distinct()


def edge_payload(edges: DataFrame) -> DataFrame:
    """(sample_id, payload): the edges of a sample as JSON, in order."""
    one = F.struct("ord", F.struct(F.col("source").alias("source_event_id"), F.col("target").alias("target_event_id"), "relation_type", F.round("score", 4).alias("score")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["e"])
    return edges.groupBy("sample_id").agg(F.to_json(F.struct(listed.alias("edges"))).alias("payload"))


def parse_predicted_edges(responses: DataFrame, events: DataFrame, relations: tuple[str, ...] = ("precedes", "causes")) -> DataFrame:
    """A model's graph: responses (sample_id, response), events (sample_id, event_id) → one row an edge that it gave, with a warning or null.

    A row without a warning is an edge. Responses without an object, or whose edges are no array, give one row with a warning and no ord.
    """
    whole = responses.select("sample_id", F.try_parse_json(json_answer("response")).alias("_j"))
    told = field(F.col("_j"), "edges")
    array = F.when(told.isNull() & F.col("_j").isNotNull(), F.array().cast("array<variant>")).otherwise(F.try_variant_get(told, "$", "array<variant>"))
    rows = whole.withColumn("_e", array).withColumn("_bad", F.when(F.col("_j").isNull(), "no JSON object").when(F.col("_e").isNull(), "edges are no array"))
    bad = rows.where("_bad is not null").select("sample_id", F.col("_bad").alias("warning"))
    e = rows.select("sample_id", F.posexplode("_e").alias("ord", "e"))
    names = {"source": "source_event_id", "target": "target_event_id", "relation_type": "relation_type", "evidence": "evidence", "_c": "confidence"}
    e = e.select("sample_id", "ord", is_object(F.col("e")).alias("_ok"), *[words(field(F.col("e"), v)).alias(k) for k, v in names.items()], field(F.col("e"), "confidence").isNull().alias("_none"))
    e = e.withColumn("relation_type", F.lower("relation_type")).withColumn("confidence", F.coalesce(F.col("_c").try_cast("double"), F.lit(0.5)))
    known = events.select("sample_id", "event_id")
    for side in ("source", "target"):
        e = e.join(known.select("sample_id", F.col("event_id").alias(side), F.lit(True).alias(f"_{side}")), ["sample_id", side], "left")
    wrong = (
        F.when(~F.col("_ok"), "no object").when(F.col("_source").isNull() | F.col("_target").isNull(), "unknown event").when(F.col("source") == F.col("target"), "self-loop")
        .when(~F.col("relation_type").isin(*relations), "unknown relation")
    )
    e = e.withColumn("_w", wrong)
    again = F.row_number().over(Window.partitionBy("sample_id", "source", "target", "relation_type", F.col("_w").isNull()).orderBy("ord"))
    warning = F.coalesce("_w", F.when(again > 1, "repeated edge"))
    odd = F.col("_w").isNull() & ~F.col("_none") & F.col("_c").try_cast("double").isNull()
    score = F.round(F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), 4)
    out = e.select("sample_id", "ord", "source", "target", "relation_type", score.alias("score"), "evidence", warning.alias("warning"), odd.alias("confidence_missing"))
    return out.unionByName(bad, allowMissingColumns=True)


def best_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, hops: int = 6) -> DataFrame:
    """(sample_id, target, score): largest product of weights over paths of at most hops edges from any start to any target.

    edges (sample_id, source, target, weight), starts and targets (sample_id, node). A hop is one join; after it each node
    keeps its best product, so the frontier never exceeds the nodes. Paths end at a target. The edges are cut and stay where the join needs
    them, so a hop shuffles the frontier alone.
    """
    best = edges.groupBy("sample_id", "source", "target").agg(F.max("weight").cast("double").alias("weight"))
    ends = targets.select("sample_id", "node").distinct()
    # from the second hop on, a target leads only to itself: found paths ride along, and each hop reads the last one once
    onward = best.join(ends.withColumnRenamed("node", "source"), ["sample_id", "source"], "left_anti")
    onward = onward.unionByName(ends.select("sample_id", F.col("node").alias("source"), F.col("node").alias("target"), F.lit(1.0).alias("weight")))
    places = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    onward = steps.cut(onward.repartition(places, "sample_id", "source")) if hops > 1 else onward
    front = starts.select("sample_id", F.col("node").alias("source"), F.lit(1.0).alias("score")).distinct()
    for hop in range(hops):
        step = front.join(onward if hop else best, ["sample_id", "source"])
        front = step.groupBy("sample_id", F.col("target").alias("source")).agg(F.max(F.col("score") * F.col("weight")).alias("score"))
    return front.join(ends.withColumnRenamed("node", "source"), ["sample_id", "source"], "left_semi").select("sample_id", F.col("source").alias("target"), "score")


def segment_softmax(edges: DataFrame, logit: Column, by: str = "target") -> DataFrame:
    """attention: softmax of the logit over the edges of each node."""
    w = Window.partitionBy("sample_id", by)
    return edges.withColumn("_e", F.exp(logit - F.max(logit).over(w))).withColumn("attention", F.col("_e") / F.sum("_e").over(w)).drop("_e")
