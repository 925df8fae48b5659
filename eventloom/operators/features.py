"""Feature tables for a graph refiner: times, nodes (10), edges (20), queries (6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import RELATIONS
from ..functions.values import clip, days_since_epoch
from .graph import degrees

DAYS = 30.0


def event_times(events: DataFrame, cutoff: Column) -> DataFrame:
    """Adds event_time (in months from the sample's anchor, clipped), time_valid, cutoff_value and cutoff_valid.

    An event's own time is its metadata's or its document's; without one, its sentence index, flagged. The anchor is the first
    observed time, else the cutoff, else 0, and never after the cutoff.
    """
    observed = F.coalesce(F.lit(None).cast("double"), *[days_since_epoch(F.col(c)) for c in ("event_time_text", "publish_time") if c in events.columns])
    rows = events.withColumn("_observed", observed).withColumn("_cut", days_since_epoch(cutoff))
    anchor = rows.groupBy("sample_id").agg(F.min("_observed").alias("_first"), F.first("_cut", ignorenulls=True).alias("_limit"))
    anchor = anchor.select("sample_id", F.least(F.coalesce("_first", "_limit", F.lit(0.0)), F.coalesce("_limit", F.lit(float("inf")))).alias("_anchor"))
    rows = rows.join(anchor, "sample_id")
    time = F.coalesce("_observed", F.col("sentence_index").cast("double"))
    return rows.select(
        *events.columns, clip((time - F.col("_anchor")) / DAYS).alias("event_time"), F.when(F.col("_observed").isNotNull(), 1.0).otherwise(0.0).alias("time_valid"),
        F.coalesce(clip((F.col("_cut") - F.col("_anchor")) / DAYS), F.lit(0.0)).alias("cutoff_value"), F.when(F.col("_cut").isNotNull(), 1.0).otherwise(0.0).alias("cutoff_valid"),
    )


def node_features(events: DataFrame, query: Column) -> DataFrame:
    """events with times → (sample_id, event_id, f0 … f9)."""
    asked = F.filter(F.split(X.collapse(F.lower(query)), " "), lambda w: w != "")
    number = [
        F.when(F.col("participants").isNull(), 0).otherwise(F.size("participants")),
        F.size(F.filter(F.split(F.coalesce("normalized_text", F.lit("")), r"\s+"), lambda w: w != "")),
        F.col("sentence_index"),
        F.col("confidence"),
        F.when(F.exists(asked, lambda w: F.contains(F.coalesce("normalized_text", F.lit("")), w)), 1).otherwise(0),
        F.coalesce(F.length("trigger"), F.lit(0)),
        F.col("event_time"),
        F.col("time_valid"),
        F.when(F.col("node_type") != "observed", 1).otherwise(0),
        F.when(F.col("is_title"), 1).otherwise(0),
    ]
    return events.select("sample_id", "event_id", *[c.cast("double").alias(f"f{k}") for k, c in enumerate(number)])


def edge_features(edges: DataFrame, events: DataFrame) -> DataFrame:
    """edges (…, source_kind coarse or completion, and up to five feature scores), events with times → (sample_id, ord, source, target, f0 … f19).

    Degrees count coarse edges only.
    """
    scores = ["temporal_score", "entity_overlap_score", "lexical_support_score", "marker_score", "query_alignment_score"]
    told = [F.coalesce(F.col(c), F.lit(0.0)) if c in edges.columns else F.lit(0.0) for c in scores]
    degree = degrees(events, edges.where("source_kind = 'coarse'"))
    facts = events.join(degree, ["sample_id", "event_id"]).select("sample_id", "event_id", "event_time", "sentence_index", "document_id", "out_degree", "in_degree")
    s, t = (facts.select("sample_id", *[F.col(c).alias(f"{k}_{c}") for c in facts.columns[1:]]).withColumnRenamed(f"{k}_event_id", name) for k, name in (("s", "source"), ("t", "target")))
    ids = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(RELATIONS) for x in (r, k)]), F.col("relation_type")), F.lit(0))
    change = clip(F.col("t_event_time") - F.col("s_event_time"))
    number = [
        F.col("score"), ids, *told, F.col("s_event_time"), F.col("t_event_time"), change, F.abs(change),
        clip((F.col("t_sentence_index") - F.col("s_sentence_index")) / 8.0, -32.0, 32.0),
        F.when(F.col("s_document_id") != F.col("t_document_id"), 1).otherwise(0),
        F.col("s_out_degree"), F.col("s_in_degree"), F.col("t_out_degree"), F.col("t_in_degree"),
        F.when((F.col("s_document_id") == F.col("t_document_id")) & (F.col("s_sentence_index") == F.col("t_sentence_index")), 1).otherwise(0),
        F.when(F.col("source_kind") == "coarse", 1).otherwise(0), F.when(F.col("source_kind") == "completion", 1).otherwise(0),
    ]
    return edges.join(s, ["sample_id", "source"]).join(t, ["sample_id", "target"]).select("sample_id", "ord", "source", "target", *[c.cast("double").alias(f"f{k}") for k, c in enumerate(number)])


def query_features(events: DataFrame, edges: DataFrame, focus_count: Column, documents: DataFrame | None = None) -> DataFrame:
    """One row a sample: focus entities, documents, events, candidate edges, cutoff value and presence.

    documents (sample_id, document_id) are all the sample has, with or without events; those that events name, where they are not given.
    """
    docs = (events if documents is None else documents).select("sample_id", "document_id").distinct().groupBy("sample_id").agg(F.count("*").alias("f1"))
    nodes = events.groupBy("sample_id").agg(F.max(focus_count).alias("f0"), F.count("*").alias("f2"), F.max("cutoff_value").alias("f4"), F.max("cutoff_valid").alias("f5"))
    counted = edges.groupBy("sample_id").agg(F.count("*").alias("f3"))
    out = nodes.join(docs, "sample_id", "left").join(counted, "sample_id", "left")
    return out.select("sample_id", *[F.coalesce(f"f{k}", F.lit(0)).cast("double").alias(f"f{k}") for k in range(6)])


def completion_edges(pairs: DataFrame, *keep: str) -> DataFrame:
    """Completion pairs (pairs.completion_pairs, with s_event_time and t_event_time) as low-scored edges."""
    apart = F.abs(F.col("t_event_time") - F.col("s_event_time"))
    both = F.size(F.array_intersect("s_participants", "t_participants"))
    return pairs.select(
        "sample_id", F.col("s_event_id").alias("source"), F.col("t_event_id").alias("target"), F.lit("precedes").alias("relation_type"),
        F.round(F.least(F.greatest("completion_score", F.lit(0.0)), F.lit(0.49)), 4).alias("score"), F.lit("completion").alias("source_kind"),
        (F.lit(1.0) / (1 + apart)).alias("temporal_score"), F.least(both / F.lit(3.0), F.lit(1.0)).alias("entity_overlap_score"),
        F.col("completion_score").alias("lexical_support_score"), F.lit(0.0).alias("marker_score"), F.col("completion_score").alias("query_alignment_score"), F.col("pair_rank").alias("ord"), *keep,
    )


def labelled_samples(candidates: DataFrame, gold: DataFrame, priority_wins: bool = False) -> DataFrame:
    """Candidates with edge_label (0 or 1), type_id and strength from gold edges; a pair's last gold edge counts, or the one of highest priority."""
    from .graph import last_labels, pair_labels

    told = (pair_labels if priority_wins else last_labels)(gold)
    strength = gold.groupBy("sample_id", "source", "target").agg(F.max_by("score", "ord").alias("strength"))
    ids = F.create_map(*[F.lit(x) for k, r in enumerate(RELATIONS) for x in (r, k)])
    out = candidates.join(told, ["sample_id", "source", "target"], "left").join(strength, ["sample_id", "source", "target"], "left")
    return out.select(*candidates.columns, F.col("label").isNotNull().cast("int").alias("edge_label"), F.coalesce(F.element_at(ids, F.col("label")), F.lit(0)).alias("type_id"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
