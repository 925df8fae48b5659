"""Answers of models: loose JSON, references, rewards, graphs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import forecast, graph, prompts, retrieval


def parsed(spark, value, read=forecast.parse_forecasts):
    text = value if isinstance(value, str) else json.dumps(value)
    return read(spark.createDataFrame([("s", text)], "sample_id string, response string")).first()


def test_names_of_fields(spark):
    got = parsed(spark, {"forecast_trace": {"events": {"mention": "alone", "participants": "A", "support_event_ids": ["e1", "e1"], "effect": "more", "confidence": "0.5"}, "edges": [{"source_event_id": "a", "target": "b", "relation": "x", "score": 7, "edge_id": " "}]}, "final_answer": {"predicted_event_base_code": 36, "supporting_events": ["e2", {"ref": "e3"}], "support_edges": [{"edge_id": "r"}], "forecast_event": "f"}})
    e, x = got.events[0], got.edges[0]
    assert (e.id, e.event, e.actors, e.event_refs, e.expected_effect, e.confidence) == ("ft_1", "alone", ["A"], ["e1"], "more", 0.5)
    assert (x.id, x.source, x.target, x.relation_type, x.confidence) == ("fte_1", "a", "b", "x", 1.0)
    assert (got.event_code, got.answer_refs, got.edge_refs, got.forecast_event) == ("36", ["e2", "e3"], ["r"], "f")
    assert got.event_refs == ["e1", "e2", "e3", "e2", "e3", "e1"] and got.support_ids == ["e2", "e3", "e1"]


def test_odd_answers(spark):
    for value in (None, "", "[1]", '{"final_answer": 3, "forecast_trace": [1]}', {"forecast_trace": None, "final_answer": None}):
        got = parsed(spark, value) if value is not None else forecast.parse_forecasts(spark.createDataFrame([("s", None)], "sample_id string, response string")).first()
        assert got.events == [] and got.edges == [] and got.event_code == "" and got.confidence == 0.0
    assert parsed(spark, "In 2024 code 042, not 0421 or 17").event_code == "042"
    assert parsed(spark, '<FINAL_ANSWER> {"event_code": "1"} </final_answer> <forecast_trace>{bad}</forecast_trace>').event_code == "1"


def test_choices_fill_each_other(spark):
    rows = spark.createDataFrame([(k, c, i) for k, (c, i) in enumerate([("", "C1"), ("036", ""), ("9", "C9"), ("", "C8")])], "k int, event_code string, choice_id string")
    choices = spark.createDataFrame([(1, "C1", "042"), (0, "C1", "041"), (2, "C3", "036"), (3, "C2", "036")], "ord int, choice_id string, event_code string")
    got = forecast.backfill_choices(rows, choices).orderBy("k").collect()
    assert [(r.event_code, r.choice_id) for r in got] == [("041", "C1"), ("036", "C3"), ("9", "C9"), ("", "C8")]


def bridge(spark, answer, edges, events=("e1", "e2", "e3"), mapping=None):
    f = forecast.parse_forecasts(spark.createDataFrame([("s", json.dumps(answer))], "sample_id string, response string")).withColumn("event_map", F.create_map(*[F.lit(x) for kv in (mapping or {"": ""}).items() for x in kv]))
    g = spark.createDataFrame([("s", *e) for e in edges], "sample_id string, source string, target string, score double")
    nodes = spark.createDataFrame([("s", e) for e in events], "sample_id string, event_id string")
    got = forecast.bridge_scores(g, f, nodes).collect()
    return round(got[0].bridge, 6) if got else 0.0


def test_bridge_starts_and_names(spark):
    edges = [("e1", "e2", 0.9), ("e2", "e3", 2.0), ("e3", "code_036", 0.5)]

    def answer(refs, link=(), **more):
        return {"forecast_trace": {"intermediate_events": [{"event": "x", "supporting_event_ids": refs}], "trace_edges": list(link)}, "final_answer": {"event_code": "036", **more}}

    assert bridge(spark, answer(["e1"]), edges) == 0.45
    assert bridge(spark, answer([]), edges) == 0.5  # from any event
    assert bridge(spark, answer(["made up"]), edges) == 0.0  # references count as they are
    assert bridge(spark, answer(["H01"]), edges, mapping={"H01": "e2"}) == 0.5
    assert bridge(spark, {**answer([]), "support_event_ids": ["e1"]}, edges) == 0.5  # those of the open object are no starts
    assert bridge(spark, answer(["e1"], [{"source_ref": "H02", "target_ref": "answer_C7", "confidence": 0.8}], choice_id="C7"), edges, mapping={"H02": "e2"}) == 0.72
    assert bridge(spark, answer(["e1"], [{"source": "e1", "target": "answer", "confidence": 1}]), edges[:1]) == 0.0
    assert bridge(spark, {"forecast_trace": {}, "final_answer": {}}, edges) == 0.0


def test_rewards_without_a_graph_and_policies(spark):
    rows = forecast.parse_forecasts(spark.createDataFrame([("s", '{"event_code": "1"}')], "sample_id string, response string")).withColumn("answers", F.array(F.lit("2"))).withColumn("event_ids", F.lit(None).cast("array<string>")).withColumn("edge_ids", F.lit(None).cast("array<string>"))
    got = forecast.policy("Trace_Reward")(rows).first()
    assert (got.answer, got.format, got.grounding, got.graph_bridge, got.generic_penalty, got.total) == (0.0, 1.0, 0.0, 0.0, 1.0, 0.05)
    assert forecast.policy(" None ")(rows).first().total == 0.0
    assert forecast.policy("mirai-code-reward")(rows).first().total == 0.0
    with pytest.raises(ValueError):
        forecast.policy("other")


def test_graph_answers(spark):
    events = spark.createDataFrame([("s", "a"), ("s", "b")], "sample_id string, event_id string")
    edges = [{"source_event_id": "a", "target_event_id": "b", "relation_type": " CAUSES ", "confidence": -1}, {"source_event_id": "a", "target_event_id": "b", "relation_type": "causes"}]
    rows = spark.createDataFrame([("s", "so {" + json.dumps({"edges": edges})[1:]), ("t", "{}"), ("u", "")], "sample_id string, response string")
    got = graph.parse_predicted_edges(rows, events).orderBy("sample_id", "ord").collect()
    assert [(r.sample_id, r.relation_type, r.score, r.warning) for r in got] == [("s", "causes", 0.0, None), ("s", "causes", 0.5, "repeated edge"), ("u", None, None, "no JSON object")]


def test_extracted_events_are_cut_and_located(spark):
    docs = spark.createDataFrame([("s", 0, "d0", "Title", "One thing. They met there."), ("s", 1, "d1", "Other", "Nothing.")], "sample_id string, ord int, document_id string, title string, text string")
    events = [{"event": "met there", "document_id": "d0"}, {"trigger": "T", "evidence": "Nothing."}, {"trigger": "T"}, 5, {"event": "z", "document_id": "d1", "confidence": None}]
    rows = spark.createDataFrame([("s", json.dumps({"events": events})), ("t", '{"events": 3}')], "sample_id string, response string")
    got = retrieval.parse_extracted_events(rows, docs, 3).orderBy("ord").collect()
    assert [(r.event_id, r.document_id, r.sentence_index, r.text) for r in got] == [
        ("qwen_e0", "d0", 2, "trigger=met; mention=met there"), ("qwen_e1", "d0", 0, "trigger=T; mention=Nothing."), ("qwen_e2", "d1", 0, "trigger=z; mention=z"),
    ]


def test_prompts(spark):
    q = spark.createDataFrame([("s", "What next?", "2030-01-01", ["A"])], "sample_id string, query string, cutoff_time string, focus_entities array<string>")
    docs = spark.createDataFrame([("s", 0, "d0", "T", "long " * 300, None)], "sample_id string, ord int, document_id string, title string, text string, publish_time string")
    events = spark.createDataFrame([("s", k, f"e{k}", "d0", k, "", f"trigger=t{k}; mention=m", ["A"] if k else [], "observed", 0.5) for k in range(3)], "sample_id string, ord int, event_id string, document_id string, sentence_index int, trigger string, text string, participants array<string>, node_type string, confidence double")
    edges = spark.createDataFrame([("s", 0, "x0", "e0", "e1", "causes", 0.5), ("s", 1, "x1", "e1", "gone", "precedes", 0.75)], "sample_id string, ord int, edge_id string, source string, target string, relation_type string, score double")
    none = spark.createDataFrame([], "choice_id string, event_code string, description string")
    got = prompts.forecast_prompts(q, docs, events, edges, none, max_events=2).first()
    assert "- H02 | event_id=e1 | doc=d0 | sent=1 | trigger=t1 | event=trigger=t1; mention=m | participants=A" in got.prompt and "H03" not in got.prompt
    assert "- R01 | edge_id=x1 | H02 --precedes:0.750--> gone | source_event_id=e1 | target_event_id=gone" in got.prompt
    assert "no choices" in got.prompt and "Cutoff date: 2030-01-01\nActors: A" in got.prompt and got.event_refs == {"H01": "e0", "H02": "e1"} and got.edge_refs == {"R01": "x1", "R02": "x0"}
    assert "- e0 [observed] trigger=t0; mention=m | participants=- | conf=0.50" in prompts.local_forecast_prompts(q, docs, events, edges).first().prompt
    assert "- e1 --precedes:0.750--> gone" in prompts.graph_forecast_prompts(q, docs, events, edges).first().prompt
    assert "[Document d0]\nDate: -\nTitle: T\nText: long" in prompts.extraction_prompts(q, docs).first().prompt
    assert "- event_id=e2 | sentence_index=2 | trigger= | mention=trigger=t2; mention=m | evidence=" in prompts.graph_prompts(docs, events.withColumn("mention", F.lit(None).cast("string")).withColumn("evidence", F.lit(None).cast("string"))).first().prompt
    row = spark.range(1).select(F.lit("d").alias("i"), F.lit("T").alias("t"), F.lit("some text here").alias("x"))
    modes = {m: row.select(prompts.render_document(F.col("i"), F.col("t"), F.col("x"), m, 8)).first()[0] for m in ("none", "title", "summary", "full")}
    assert modes == {"none": "", "title": "[Document d]\nTitle: T", "summary": "[Document d]\nTitle: T\nSnippet: some...", "full": "[Document d]\nTitle: T\nText: some text here"}
    with pytest.raises(ValueError):
        prompts.render_document(F.lit(""), F.lit(""), F.lit(""), "other")
