"""Prompts as text columns: rendering is aggregation and string functions, so it scales with the tables.

The formats of blocks (documents, events, edges, choices, pairs) are fixed values, as models are trained on them; the instructions
around them are this engine's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.lexicons import PAIR_LABELS

MODES = {"none": "none", "title": "title", "snippet": "snippet", "summary": "snippet", "full": "full"}


def _mode(name: str) -> str:
    if name.strip().lower() not in MODES:
        raise ValueError(f"unknown mode {name!r}; known: {', '.join(MODES)}")
    return MODES[name.strip().lower()]


def _part(label: str, value: Column) -> Column:
    """label and value; null where the value is empty, so that concat_ws leaves it out."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _or_dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("-"))


def render_document(document_id: Column, title: Column, text: Column, mode: str = "title", most: int = 320, role: str = "") -> Column:
    """A document's block: its id, its title and, by mode, its text, whole or cut. Mode none is empty."""
    kind = _mode(mode)
    if kind == "none":
        return F.lit("")
    body = {"title": F.lit(None).cast("string"), "snippet": _part("Snippet: ", X.compact(text, most)), "full": F.concat(F.lit("Text: "), F.coalesce(text, F.lit("")))}[kind]
    head = F.concat(F.lit(f"[{role} Document " if role else "[Document "), document_id, F.lit("]"))
    return F.concat_ws("\n", head, _part("Title: ", title), body)


def render_event(prefix: str) -> Column:
    """The block of one side (s or t) of a pair; title and context are left out where there is none."""
    c = {k: F.col(f"{prefix}_{k}") for k in ("event_id", "document_id", "sentence_index", "trigger", "text", "title", "context")}
    context = F.when(c["context"] != c["text"], c["context"])
    return F.concat_ws(
        "\n", F.concat(F.lit("id="), c["event_id"]), F.concat(F.lit("doc="), c["document_id"]), F.concat(F.lit("sent="), c["sentence_index"]),
        _part("trigger=", c["trigger"]), _part("title=", c["title"]), F.concat(F.lit("event="), c["text"]), _part("context=", context),
    )


def pair_instructions(pairs: DataFrame, query: Column | None = None, documents: DataFrame | None = None, mode: str = "title", most: int = 240) -> DataFrame:
    """Adds prompt and target for a pair classifier: both events, their documents and what the pair shares.

    documents (sample_id, document_id, title, text) may lack some; columns s_context and t_context (the mention's words) are optional.
    """
    rows, names = pairs, pairs.columns
    for side in ("s", "t"):
        if f"{side}_context" not in names:
            rows = rows.withColumn(f"{side}_context", F.lit(None).cast("string"))
        if documents is None:
            rows = rows.withColumns({f"{side}_{c}": F.lit(None).cast("string") for c in ("known", "title", "body")})
        else:
            d = documents.select("sample_id", *[F.col(c).alias(f"{side}_{n}") for c, n in (("document_id", "document_id"), ("title", "title"), ("text", "body"))]).withColumn(f"{side}_known", F.lit("yes"))
            rows = rows.join(d, ["sample_id", f"{side}_document_id"], "left")
    blocks = []
    for side, role in (("s", "Source"), ("t", "Target")):
        block = render_document(F.col(f"{side}_document_id"), F.col(f"{side}_title"), F.col(f"{side}_body"), mode, most, role)
        wanted = F.col(f"{side}_known").isNotNull()
        wanted = wanted if side == "s" else wanted & ~(F.col("s_known").isNotNull() & (F.col("s_document_id") == F.col("t_document_id")))
        blocks.append(F.when(wanted, block))
    context = F.nullif(F.concat_ws("\n\n", *blocks), F.lit("")) if _mode(mode) != "none" else F.lit(None).cast("string")
    both = F.array_join(F.array_sort(F.array_intersect("s_participants", "t_participants")), ", ")
    shared = F.concat_ws(
        "\n", F.concat(F.lit("same_document="), (F.col("s_document_id") == F.col("t_document_id")).cast("int")),
        F.concat(F.lit("sentence_gap="), F.col("t_sentence_index") - F.col("s_sentence_index")), F.concat(F.lit("shared_participants="), F.coalesce(F.nullif(both, F.lit("")), F.lit("none"))),
    )
    parts = [
        F.lit(f"Which relation leads from the source event to the target event?\nOne of: {', '.join(PAIR_LABELS)}; none where the texts support no such relation.\nAnswer with JSON only: {{\"relation_type\": ..., \"score\": ...}}"),
        _part("Query: ", query) if query is not None else F.lit(None).cast("string"), F.concat(F.lit("Source Event:\n"), render_event("s")), F.concat(F.lit("Target Event:\n"), render_event("t")),
        _part("Document Context:\n", context), F.concat(F.lit("Metadata:\n"), shared),
    ]
    label = F.col("relation_type") if "relation_type" in names else F.lit("none")
    rows = rows.withColumn("prompt", F.concat_ws("\n\n", *parts)).withColumn("target", F.to_json(F.struct(label.alias("relation_type"), F.round("score", 4).alias("score"))))
    return rows.select(*names, "prompt", "target")


def numbered(rows: DataFrame, order: list[Column], most: int, prefix: str) -> DataFrame:
    """The first rows of each sample with short references like H01."""
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).withColumn("ref", F.format_string(prefix + "%02d", "_n"))


def _block(rows: DataFrame, line: Column, name: str, separator: str = "\n") -> DataFrame:
    return rows.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda r: r["line"]), separator).alias(name))


def _documents_block(documents: DataFrame, most: int, head: str = "[Document ") -> DataFrame:
    d = documents.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("ord")))
    line = F.concat_ws("\n", F.concat(F.lit(head), "document_id", F.lit("]")), F.concat(F.lit("Date: "), _or_dash(F.col("publish_time"))), F.concat(F.lit("Title: "), X.compact(F.coalesce("title", F.lit("")), 180)), F.concat(F.lit("Text: "), X.compact(F.coalesce("text", F.lit("")), most)))
    return _block(d, line, "docs", "\n\n")


def _edge_ends(edges: DataFrame, names: DataFrame) -> DataFrame:
    out = edges
    for side in ("source", "target"):
        out = out.join(names.select("sample_id", F.col("event_id").alias(side), F.col("ref").alias(f"_{side}")), ["sample_id", side], "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return out


def _score(c: str = "score") -> Column:
    return F.format_string("%.3f", F.col(c).cast("double"))


def _joined(queries: DataFrame, parts: list[DataFrame]) -> DataFrame:
    for p in parts:
        queries = queries.join(p, "sample_id", "left")
    return queries


def _head(queries: DataFrame) -> list[Column]:
    """The lines about a query; columns query_id, cutoff_time and focus_entities are optional."""
    have = queries.columns
    actors = F.array_join("focus_entities", ", ") if "focus_entities" in have else F.lit(None).cast("string")
    return [
        *([F.concat(F.lit("QueryId: "), "query_id")] if "query_id" in have else []), F.concat(F.lit("Query: "), "query"),
        F.concat(F.lit("Cutoff date: "), _or_dash(F.col("cutoff_time") if "cutoff_time" in have else F.lit(None).cast("string"))), F.concat(F.lit("Actors: "), _or_dash(actors)),
    ]


def forecast_prompts(queries: DataFrame, documents: DataFrame, events: DataFrame, edges: DataFrame, choices: DataFrame, max_events: int = 24, max_edges: int = 48, document_chars: int = 700) -> DataFrame:
    """(sample_id, prompt, event_refs, edge_refs): choices, documents, the first events and the best edges of each query, with references H01 and R01."""
    e = numbered(events, [F.col("ord")], max_events, "H")
    r = _edge_ends(numbered(edges, [F.desc("score"), F.col("ord")], max_edges, "R"), e.select("sample_id", "event_id", "ref"))
    event_line = F.concat(F.lit("- "), F.concat_ws(
        " | ", "ref", F.concat(F.lit("event_id="), "event_id"), F.concat(F.lit("doc="), "document_id"), F.concat(F.lit("sent="), "sentence_index"),
        F.concat(F.lit("trigger="), X.display_trigger(F.coalesce("trigger", F.lit("")), F.col("text"))), F.concat(F.lit("event="), "text"), F.concat(F.lit("participants="), _or_dash(F.array_join("participants", ", "))),
    ))
    edge_line = F.concat(F.lit("- "), F.concat_ws(
        " | ", "ref", F.concat(F.lit("edge_id="), "edge_id"), F.concat("_source", F.lit(" --"), "relation_type", F.lit(":"), _score(), F.lit("--> "), "_target"),
        F.concat(F.lit("source_event_id="), "source"), F.concat(F.lit("target_event_id="), "target"),
    ))
    refs = e.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "event_id")))).alias("event_refs"))
    edge_refs = r.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "edge_id")))).alias("edge_refs"))
    option = F.concat(F.lit("- "), F.concat_ws(" | ", "choice_id", F.concat(F.lit("event_code="), "event_code"), F.concat(F.lit("description="), _or_dash(F.col("description")))))
    options = choices.agg(F.array_join(F.array_sort(F.collect_list(option)), "\n").alias("options"))  # one row: the vocabulary of codes is small
    out = _joined(queries, [_documents_block(documents, document_chars), _block(e, event_line, "event_block"), _block(r, edge_line, "edge_block"), refs, edge_refs])

    def block(title: str, c: str, none: str = "- none") -> Column:
        return F.concat(F.lit(f"{title}:\n"), F.coalesce(F.nullif(c, F.lit("")), F.lit(none)))

    intro = F.lit("Forecast the event that comes next. Give the events on the way to it, each with the events and edges below that support it, then one of the choices.\nAnswer with <forecast_trace>{...}</forecast_trace> and <final_answer>{...}</final_answer>, JSON inside; use references such as H01 and R01, and answer_C001 for a choice.")
    head = F.concat_ws("\n", *_head(queries))
    prompt = F.concat_ws("\n\n", intro, head, block("Choices", "options", "- no choices; answer with a three-digit event_code"), block("Documents", "docs"), block("Visible historical events", "event_block"), block("Refined causal edges", "edge_block"))
    return out.crossJoin(F.broadcast(options)).select("sample_id", prompt.alias("prompt"), "event_refs", "edge_refs")  # options is one row


def graph_forecast_prompts(queries: DataFrame, documents: DataFrame, events: DataFrame, edges: DataFrame, max_events: int = 24, max_edges: int = 48) -> DataFrame:
    """(sample_id, prompt) for one flat answer from a refined graph: documents by title, the first events, the best edges by their ids."""
    e = numbered(events, [F.col("ord")], max_events, "H")
    r = numbered(edges, [F.desc("score"), F.col("ord")], max_edges, "R")
    d = documents.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("ord")))
    doc_line = F.concat(F.lit("- "), F.concat_ws(" | ", "document_id", _or_dash(F.col("publish_time")), X.compact(F.coalesce("title", F.lit("")), 160)))
    event_line = F.concat(F.lit("- "), F.concat_ws(" | ", "event_id", F.concat(F.lit("doc="), "document_id"), F.concat(F.lit("sent="), "sentence_index"), "text"))
    edge_line = F.concat(F.lit("- "), "source", F.lit(" --"), "relation_type", F.lit(":"), _score(), F.lit("--> "), "target")
    out = _joined(queries, [_block(d, doc_line, "docs"), _block(e, event_line, "event_block"), _block(r, edge_line, "edge_block")])
    keys = "abstain, predicted_event_base_code, alternative_event_base_codes, predicted_relation_name, forecast_event, confidence, rationale, support_event_ids"
    parts = [F.concat(F.lit(f"{t}:\n"), F.coalesce(F.col(c), F.lit("- none"))) for t, c in (("Documents", "docs"), ("Refined graph events", "event_block"), ("Refined causal edges", "edge_block"))]
    return out.select("sample_id", F.concat_ws("\n\n", F.lit(f"Forecast the next event of the query from this graph alone. Answer with one JSON object with the keys {keys}."), F.concat_ws("\n", *_head(queries)), *parts).alias("prompt"))


def local_forecast_prompts(queries: DataFrame, documents: DataFrame, events: DataFrame, edges: DataFrame, max_events: int = 8, max_edges: int = 10) -> DataFrame:
    """(sample_id, prompt) for a free answer from a local graph."""
    e = numbered(events, [F.col("ord")], max_events, "H")
    r = numbered(edges, [F.col("ord")], max_edges, "R")
    d = documents.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("ord")))
    doc_line = F.concat(F.lit("- "), F.concat_ws(" | ", "document_id", _or_dash(F.col("publish_time")), F.coalesce("title", F.lit(""))))
    event_line = F.concat(F.lit("- "), "event_id", F.lit(" ["), "node_type", F.lit("] "), "text", F.lit(" | participants="), _or_dash(F.array_join("participants", ", ")), F.lit(" | conf="), F.format_string("%.2f", F.col("confidence").cast("double")))
    edge_line = F.concat(F.lit("- "), "edge_id", F.lit(": "), "source", F.lit(" --"), "relation_type", F.lit("/"), F.format_string("%.2f", F.col("score").cast("double")), F.lit("--> "), "target")
    out = _joined(queries, [_block(d, doc_line, "docs"), _block(e, event_line, "event_block"), _block(r, edge_line, "edge_block")])
    parts = [F.concat(F.lit(f"{t}:\n"), F.coalesce(F.col(c), F.lit(""))) for t, c in (("Query", "query"), ("Retrieved evidence documents", "docs"), ("Local events", "event_block"), ("Local edges", "edge_block"))]
    return out.select("sample_id", F.concat_ws("\n\n", F.lit("Forecast an event from the graph below, or abstain where it is too weak. Answer with one JSON object with the keys abstain, forecast_event, confidence, rationale, support_event_ids."), *parts).alias("prompt"))


def extraction_prompts(queries: DataFrame, documents: DataFrame, max_events: int = 12, document_chars: int = 1200) -> DataFrame:
    """(sample_id, prompt) that asks a model for the events of each query's documents."""
    out = _joined(queries, [_documents_block(documents, document_chars)])
    ask = F.lit(f"List the concrete events in these documents that matter to the query, at most {max_events}, none of them invented.\nAnswer with JSON only: {{\"events\": [...]}}, each with document_id, trigger, event, evidence, participants, confidence.")
    return out.select("sample_id", F.concat_ws("\n\n", ask, F.concat(F.lit("Query: "), "query"), F.concat(F.lit("Documents:\n"), F.coalesce("docs", F.lit("- none")))).alias("prompt"))


def graph_prompts(documents: DataFrame, events: DataFrame, document_chars: int = 0) -> DataFrame:
    """(sample_id, prompt) that asks a model for the edges among given events of a sample's first document; document_chars 0 cuts nothing."""
    first = documents.groupBy("sample_id").agg(F.min_by(F.struct("title", "text"), "ord").alias("d"))
    e = events.withColumn("_n", F.row_number().over(Window.partitionBy("sample_id").orderBy("ord")))
    line = F.concat(F.lit("- "), F.concat_ws(" | ", F.concat(F.lit("event_id="), "event_id"), F.concat(F.lit("sentence_index="), "sentence_index"), F.concat(F.lit("trigger="), F.coalesce("trigger", F.lit(""))), F.concat(F.lit("mention="), F.coalesce("mention", "text")), F.concat(F.lit("evidence="), X.compact(F.coalesce("evidence", F.lit("")), 300))))
    out = first.join(_block(e, line, "event_block"), "sample_id", "left")
    ask = F.lit("Give the relations among these events that the document supports: precedes or causes, from source to target. Keep the event ids as they are.\nAnswer with JSON only: {\"edges\": [...]}, each with source_event_id, target_event_id, relation_type, confidence, evidence.")
    return out.select("sample_id", F.concat_ws("\n\n", ask, F.concat_ws("\n", F.concat(F.lit("Document title: "), "d.title"), F.concat(F.lit("Document text:\n"), X.compact(F.col("d.text"), document_chars))), F.concat(F.lit("Event mentions:\n"), F.coalesce("event_block", F.lit("")))).alias("prompt"))
