"""Structured forecasts: parsing model text, grounding in a graph, rewards.

Model text is loose JSON: fields go by several names, a list may be one value, an event may be a text or an object. It is read as
variants in the JVM; only the search for the JSON in a text is Python. JSON's null counts as an absent field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import clamp01, field, first_json_object, is_object, is_true, listed, outer_json, safe_div, tagged, texts, words
from .graph import best_paths

CODE = r"\b\d{3}\b"


def _or(value: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), other)


def _refs(item: Column, ids: list[str], objects: list[str], names: list[str]) -> Column:
    """Distinct references in order: ids as given, then those of objects under one of several names (or given as texts)."""
    of = F.transform(listed(field(item, *objects)), lambda x: F.when(is_object(x), words(field(x, *names))).otherwise(words(x)))
    return F.array_distinct(F.filter(F.concat(texts(field(item, *ids)), of), lambda x: x != ""))


def event_refs(item: Column) -> Column:
    return _refs(item, ["supporting_event_ids", "support_event_ids"], ["supporting_events", "support_events"], ["event_ref", "event_id", "ref"])


def edge_refs(item: Column) -> Column:
    return _refs(item, ["supporting_edge_ids", "supporting_edge_refs", "support_edge_ids"], ["supporting_edges", "support_edges"], ["edge_ref", "edge_id", "ref"])


def _first_text(value: Column, *names: str) -> Column:
    """The first of an object's fields that is no empty text."""
    return F.coalesce(*[F.nullif(words(field(value, n)), F.lit("")) for n in names], F.lit(""))


def _trace_event(item: Column, place: Column) -> Column:
    """An event of a trace; item may be a text, and its event an object of its own."""
    told = field(item, "event")
    inner = F.when(is_object(told), told)
    name = F.when(inner.isNotNull(), _first_text(told, "mention", "normalized_event", "event", "text", "trigger")).when(told.isNotNull(), words(told)).otherwise(words(field(item, "mention", "text")))
    own = texts(field(inner, "actors", "participants"))
    return F.struct(
        _or(words(field(item, "trace_event_id", "id")), F.concat(F.lit("ft_"), place + 1)).alias("id"),
        F.when(is_object(item), name).otherwise(words(item)).alias("event"),
        F.coalesce(words(F.coalesce(field(item, "trigger"), field(inner, "trigger"))), F.lit("")).alias("trigger"),
        _or(words(field(item, "relative_time")), words(field(inner, "relative_time"))).alias("relative_time"),
        F.when(F.size(own) > 0, own).otherwise(texts(field(item, "actors", "participants"))).alias("actors"),
        event_refs(item).alias("event_refs"), edge_refs(item).alias("edge_refs"), words(field(item, "expected_effect", "effect")).alias("expected_effect"),
        clamp01(words(field(item, "confidence"))).alias("confidence"),
    )


def _trace_edge(item: Column, place: Column) -> Column:
    def end(side: str) -> Column:
        return words(field(item, *[side + x for x in ("_ref", "_id", "", "_event_id")]))

    return F.struct(
        _or(words(field(item, "trace_edge_id", "edge_id")), F.concat(F.lit("fte_"), place + 1)).alias("id"), end("source").alias("source"), end("target").alias("target"),
        _or(words(field(item, "relation_type", "relation")), F.lit("causes")).alias("relation_type"), clamp01(words(field(item, "confidence", "score"))).alias("confidence"),
    )


def parse_forecasts(rows: DataFrame, text: str = "response") -> DataFrame:
    """Model answers in text → parsed_json, has_trace, events, edges, the final answer's fields, event_refs and edge_refs (of events and answer,
    with multiplicity), support_ids (distinct), alternatives, abstain, relation_name, forecast_event, confidence, rationale.

    Tagged parts win over those of the text's first object. Without any object the first number of three digits is the code.
    Alternatives are the whole object's, less the code.
    """
    raw = F.col(text)
    out = rows.withColumn("_w", first_json_object(raw)).withColumn("_t", first_json_object(tagged(raw, "forecast_trace"))).withColumn("_a", first_json_object(tagged(raw, "final_answer")))
    out = out.withColumn("parsed_json", F.coalesce("_w", "_t", "_a").isNotNull())
    out = out.withColumns({c: F.try_parse_json(c) for c in ("_w", "_t", "_a")})
    whole, empty = F.col("_w"), F.parse_json(F.lit("{}"))
    trace = F.coalesce("_t", field(whole, "forecast_trace"), F.when(field(whole, "intermediate_events", "trace_edges").isNotNull(), whole), empty)
    given = F.coalesce("_a", field(whole, "final_answer"))
    out = out.withColumn("_flat", given.isNull()).withColumn("_t", F.when(is_object(trace), trace).otherwise(empty)).withColumn("_a", F.when(given.isNull(), whole).when(is_object(given), given).otherwise(empty))
    out = out.withColumn("events", F.transform(listed(field(F.col("_t"), "intermediate_events", "events")), _trace_event))
    out = out.withColumn("edges", F.transform(listed(field(F.col("_t"), "trace_edges", "edges")), _trace_edge))
    answer, found = F.col("_a"), F.regexp_extract(raw, CODE, 0)
    # an answer in the open object has a few of the names only
    told = F.when(F.col("_flat"), F.array_distinct(texts(field(answer, "supporting_event_ids", "support_event_ids")))).otherwise(event_refs(answer))
    links = F.when(F.col("_flat"), F.array_distinct(texts(field(answer, "supporting_edge_ids")))).otherwise(edge_refs(answer))
    name = F.when(F.col("_flat"), words(field(answer, "forecast_event"))).otherwise(words(field(answer, "event", "forecast_event")))
    out = out.withColumns({
        "event_code": F.when(F.col("parsed_json"), words(field(answer, "event_code", "predicted_event_base_code"))).otherwise(F.coalesce(found, F.lit(""))),
        "choice_id": words(field(answer, "choice_id", "answer_choice")), "answer_refs": told, "answer_edge_refs": links, "_name": name,
        "confidence": clamp01(words(field(answer, "confidence"))),
    })
    of_events = F.flatten(F.transform("events", lambda e: e["event_refs"]))
    named = F.array_join(F.filter(F.transform("events", lambda e: e["event"]), lambda x: x != ""), "; ")
    out = out.withColumn("support_ids", F.array_distinct(F.concat("answer_refs", of_events)))
    return out.select(
        *rows.columns, "parsed_json", F.lit(True).alias("has_trace"), "events", "edges", "event_code", "choice_id",
        F.filter(texts(field(whole, "alternative_event_base_codes")), lambda x: x != F.col("event_code")).alias("alternatives"), "answer_refs",
        F.concat(of_events, "answer_refs", "support_ids").alias("event_refs"), F.concat(F.flatten(F.transform("events", lambda e: e["edge_refs"])), "answer_edge_refs").alias("edge_refs"), "support_ids",
        is_true(field(whole, "abstain")).alias("abstain"), words(field(whole, "predicted_relation_name")).alias("relation_name"), _or(F.col("_name"), named).alias("forecast_event"),
        "confidence", words(field(whole, "rationale", "explanation")).alias("rationale"),
    )


def _only_list(value: Column) -> Column:
    return F.coalesce(F.transform(F.try_variant_get(value, "$", "array<variant>"), words), F.array().cast("array<string>"))


def parse_flat_forecasts(rows: DataFrame, text: str = "response") -> DataFrame:
    """Answers that are one flat object: a code, alternatives, an event and supporting ids, no trace. Lists must be lists.

    Without an object the first number of three digits is the code, and the text is the event.
    """
    raw = F.col(text)
    out = rows.withColumn("_w", first_json_object(raw)).withColumn("parsed_json", F.col("_w").isNotNull()).withColumn("_w", F.try_parse_json("_w"))
    whole, fine = F.col("_w"), F.col("parsed_json")
    return out.select(
        *rows.columns, "parsed_json", F.lit(False).alias("has_trace"), F.when(fine, words(field(whole, "predicted_event_base_code"))).otherwise(F.coalesce(F.regexp_extract(raw, CODE, 0), F.lit(""))).alias("event_code"),
        F.filter(_only_list(field(whole, "alternative_event_base_codes")), lambda x: x != "").alias("alternatives"), is_true(field(whole, "abstain")).alias("abstain"),
        words(field(whole, "predicted_relation_name")).alias("relation_name"), F.when(fine, words(field(whole, "forecast_event"))).otherwise(F.coalesce(F.trim(raw), F.lit(""))).alias("forecast_event"),
        clamp01(words(field(whole, "confidence"))).alias("confidence"), words(field(whole, "rationale")).alias("rationale"), _only_list(field(whole, "support_event_ids")).alias("support_ids"),
    )


def parse_free_forecasts(rows: DataFrame, text: str = "response") -> DataFrame:
    """Answers without a closed set: the text, or all from its first brace to its last, as an object → at most one candidate event.

    A text that is no object is itself the candidate, with confidence 0; an object without an event gives none (null).
    """
    out = rows.withColumn("_w", outer_json(F.col(text))).withColumn("parsed_json", F.col("_w").isNotNull()).withColumn("_w", F.try_parse_json("_w"))
    whole, fine = F.col("_w"), F.col("parsed_json")
    named = F.nullif(words(field(whole, "forecast_event")), F.lit(""))
    return out.select(
        *rows.columns, "parsed_json", is_true(field(whole, "abstain")).alias("abstain"), F.when(fine, named).otherwise(F.coalesce(F.trim(F.col(text)), F.lit(""))).alias("forecast_event"),
        F.when(~fine, 0.0).when(named.isNotNull(), clamp01(words(field(whole, "confidence")))).alias("confidence"), F.when(fine & named.isNotNull(), words(field(whole, "rationale"))).otherwise("").alias("rationale"),
        F.when(fine & named.isNotNull(), _only_list(field(whole, "support_event_ids"))).otherwise(F.array().cast("array<string>")).alias("support_ids"),
    )


def normalize_choices(choices: DataFrame) -> DataFrame:
    """choices (ord, choice_id, event_code, description) without those that have no code; a missing id is made of the place, from C001."""
    code = F.trim(F.coalesce("event_code", F.lit("")))
    place = F.format_string("C%03d", F.col("ord") + 1)
    out = choices.select("ord", _or(F.trim(F.coalesce("choice_id", F.lit(""))), place).alias("choice_id"), code.alias("event_code"), F.trim(F.coalesce("description", F.lit(""))).alias("description"))
    return out.where("event_code <> ''")


def backfill_choices(forecasts: DataFrame, choices: DataFrame) -> DataFrame:
    """Fills a missing code from the choice id, and a missing choice id from the code: the first choice (by ord) with it."""
    by_id = choices.groupBy("choice_id").agg(F.min_by("event_code", "ord").alias("_code"))
    out = forecasts.join(by_id, "choice_id", "left").withColumn("event_code", _or(F.col("event_code"), F.coalesce("_code", F.lit(""))))
    by_code = choices.groupBy("event_code").agg(F.min_by("choice_id", "ord").alias("_choice"))
    out = out.join(by_code, "event_code", "left").withColumn("choice_id", _or(F.col("choice_id"), F.coalesce("_choice", F.lit(""))))
    return out.select(*forecasts.columns)


def resolve(refs: Column, mapping: Column) -> Column:
    """References as ids by a map; those not in it stay. A null map resolves nothing."""
    return F.transform(refs, lambda r: F.coalesce(F.try_element_at(mapping, F.trim(r)), F.trim(r)))


def valid_ratio(refs: Column, ids: Column) -> Column:
    """Share of the references that are among ids, each as often as it is given; 0 without one."""
    return safe_div(F.size(F.filter(refs, lambda r: F.array_contains(ids, r))), F.size(refs))


NO_MAP = "map<string,string>"
NONE = "array<string>"


def _with(rows: DataFrame, **defaults: Column) -> DataFrame:
    return rows.withColumns({k: v for k, v in defaults.items() if k not in rows.columns})


def code_reward(rows: DataFrame) -> DataFrame:
    """answer: 1 where the code is right, a half where an alternative is, else 0."""
    return rows.withColumn("answer", F.round(_code_reward(), 6)).withColumn("total", F.col("answer"))


def _code_reward() -> Column:
    gold = F.filter(F.transform("answers", lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(gold) <= 0, 0.0).when(F.array_contains(gold, F.col("event_code")), 1.0).when(F.arrays_overlap(gold, "alternatives"), 0.5).otherwise(0.0)


#: weights of the reward's parts, and the most that the trace is worth where the answer is wrong
WEIGHTS = {"answer": 1.0, "format": 0.2, "grounding": 0.2, "temporal": 0.2, "graph_bridge": 0.3, "generic_penalty": -0.15, "density_penalty": -0.15}
WRONG_ANSWER_CAP, FREE_EVENTS, FREE_EDGES = 0.2, 3, 5


def reward_parts(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Parsed forecasts with answers, choices (arrays choice_ids, choice_codes), the graph's ids (event_ids, edge_ids; null without a graph),
    maps of references (event_map, edge_map) and bridge → the reward's parts and total. Columns that are not there count as empty."""
    none = F.array().cast(NONE)
    rows = _with(rows, event_map=F.lit(None).cast(NO_MAP), edge_map=F.lit(None).cast(NO_MAP), choice_ids=none, choice_codes=none, bridge=F.lit(0.0))
    choice = F.when(F.size("choice_codes") + F.size("choice_ids") <= 0, 1.0).when(((F.col("event_code") != "") & F.array_contains("choice_codes", F.col("event_code"))) | ((F.col("choice_id") != "") & F.array_contains("choice_ids", F.col("choice_id"))), 1.0).otherwise(0.0)

    def one(c: Column) -> Column:
        return F.when(c, 1.0).otherwise(0.0)

    n = F.size("events")
    form = 0.25 * one(F.col("parsed_json")) + 0.25 * one(F.col("has_trace")) + 0.25 * one(F.col("event_code") != "") + 0.25 * choice
    known = F.col("event_ids").isNotNull()
    told = F.when(known, valid_ratio(resolve(F.col("event_refs"), F.col("event_map")), F.col("event_ids"))).otherwise(0.0)
    linked = F.when(known, valid_ratio(resolve(F.col("edge_refs"), F.col("edge_map")), F.coalesce("edge_ids", none))).otherwise(0.0)
    times = F.transform("events", lambda e: X.relative_time_score(e["relative_time"]))
    temporal = F.when(n > 0, F.aggregate(times, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    generic = F.when(n > 0, F.size(F.filter("events", lambda e: X.is_generic(e["event"]))) / n).otherwise(1.0)
    density = F.least(F.greatest(n - FREE_EVENTS, F.lit(0)) + F.greatest(F.size("edges") - FREE_EDGES, F.lit(0)), F.lit(4)) / 4.0
    parts = {
        "answer": _code_reward(), "format": form, "grounding": 0.65 * told + 0.35 * linked, "valid_event_ref_ratio": told, "valid_edge_ref_ratio": linked, "temporal": temporal,
        "graph_bridge": F.when(known, F.coalesce("bridge", F.lit(0.0))).otherwise(0.0), "generic_penalty": generic, "density_penalty": density,
    }
    out = rows.withColumns(parts)
    trace = sum((w * F.col(k) for k, w in weights.items() if k != "answer"), F.lit(0.0))
    out = out.withColumn("_trace", F.when(F.col("answer") <= 0, F.least(trace, F.lit(WRONG_ANSWER_CAP))).otherwise(trace))
    return out.withColumn("total", F.round(weights["answer"] * F.col("answer") + F.col("_trace"), 6)).withColumns({k: F.round(k, 6) for k in parts}).drop("_trace")


#: reward policies by name: each adds total, and the parts that it has
POLICIES: dict[str, Callable[[DataFrame], DataFrame]] = {"noop": lambda rows: rows.withColumn("total", F.lit(0.0)), "code": code_reward, "forecast_trace": reward_parts}
#: the names that policies go by, other than their own
ALIASES = {"": "noop", "none": "noop", "mirai_code_reward": "code", "forecast_trace_reward": "forecast_trace", "trace_reward": "forecast_trace"}


def policy(name: str = "noop") -> Callable[[DataFrame], DataFrame]:
    key = name.strip().lower().replace("-", "_")
    key = ALIASES.get(key, key)
    if key not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[key]


def answer_aliases(*values: Column) -> Column:
    """The names under which paths may lead to an answer: each value, and that with answer_, choice_ and code_ before it."""
    given = F.filter(F.array(*[F.trim(v) for v in values]), lambda v: v != "")
    return F.array_distinct(F.flatten(F.transform(given, lambda v: F.array(v, *[F.concat(F.lit(x), v) for x in ("answer_", "choice_", "code_")]))))


def bridge_scores(graph_edges: DataFrame, forecasts: DataFrame, graph_events: DataFrame, hops: int = 6) -> DataFrame:
    """(sample_id, bridge): best path over the graph's and the trace's edges from the supporting events of trace and answer to a name of the answer.

    References count as they are resolved, in the graph or not; only a forecast without any starts from all events of the graph.
    forecasts may have event_map, a map of references.
    """
    f = _with(forecasts, event_map=F.lit(None).cast(NO_MAP))
    told = f.select("sample_id", "event_map", F.explode("edges").alias("e"))
    ends = [F.element_at(resolve(F.array(f"e.{side}"), F.col("event_map")), 1).alias(side) for side in ("source", "target")]
    told = told.select("sample_id", *ends, F.col("e.confidence").alias("weight"))
    edges = graph_edges.select("sample_id", "source", "target", clamp01(F.col("score")).alias("weight")).unionByName(told).where("source <> '' and target <> ''")
    own = F.concat(F.flatten(F.transform("events", lambda e: e["event_refs"])), F.col("answer_refs"))
    named = f.select("sample_id", F.array_distinct(F.filter(resolve(own, F.col("event_map")), lambda r: r != "")).alias("refs"))
    all_events = graph_events.select("sample_id", F.col("event_id").alias("node")).join(named.where("size(refs) = 0").select("sample_id"), "sample_id", "left_semi")
    starts = named.select("sample_id", F.explode("refs").alias("node")).unionByName(all_events)
    targets = f.select("sample_id", F.explode(answer_aliases(F.col("choice_id"), F.col("event_code"))).alias("node"))
    return best_paths(edges, starts, targets, hops).groupBy("sample_id").agg(F.max("score").alias("bridge"))


def trajectory(*steps: DataFrame) -> DataFrame:
    """Append-only step table (sample_id, step_idx, name, observation, action, reward) from step tables in order."""
    out = None
    for k, step in enumerate(steps):
        one = step.select("sample_id", F.lit(k).alias("step_idx"), "name", "observation", "action", "reward")
        out = one if out is None else out.unionByName(one)
    return out


def latest_step(steps: DataFrame, name: str) -> DataFrame:
    return steps.where(F.col("name") == name).groupBy("sample_id").agg(F.max_by(F.struct("observation", "action", "reward"), "step_idx").alias("step")).select("sample_id", "step.*")
