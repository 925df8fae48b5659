"""Whole plans, gold samples, sinks, and the smaller reports."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import features, graph, metrics, retrieval
from eventloom.plans import graphs
from eventloom.sources import corpora as C
from eventloom.sources import files


def test_bridges_go_on_with_the_ids(spark):
    rows = [("raise prices", 0, 0, ["Acme", "Bank"]), ("they delay orders", 1, 0, ["Bank", "Acme"]), ("crowds protest", 1, 1, ["Acme"]), ("it will expand", 0, 1, ["Acme"]), ("raise rates and delay", 2, 0, ["Other"])]
    events = spark.createDataFrame([("q", f"e{k}", k, f"d{r}", r, s, t, t, p, 0.5, "observed", "") for k, (t, r, s, p) in enumerate(rows)], "sample_id string, event_id string, ord int, document_id string, rank int, sentence_index int, text string, normalized_text string, participants array<string>, confidence double, node_type string, trigger string")
    focus = spark.createDataFrame([("q", ["Acme", "Bank", "Other"])], "sample_id string, focus array<string>")
    edges = graph.neighbour_edges(events)
    more, links = graphs.bridges(events, edges, focus)
    # the first two pairs in the order of documents and sentences: e0 with e3 of its document, then with e1
    got = [(r.event_id, r.text, r.participants, r.document_id, r.node_type) for r in more.orderBy("ord").collect()]
    assert got == [("e5", "conditions around Acme shifted", ["Acme"], "bridge", "bridge_hypothesis"), ("e6", "conditions around Acme, Bank shifted", ["Acme", "Bank"], "bridge", "bridge_hypothesis")]
    told = [(r.edge_id, r.source, r.target, r.relation_type, r.score) for r in links.orderBy("ord").collect()]
    assert told == [("edge2", "e0", "e5", "enables", 0.4), ("edge3", "e5", "e3", "causes", 0.4), ("edge4", "e0", "e6", "enables", 0.4), ("edge5", "e6", "e1", "causes", 0.4)]
    assert graphs.bridges(events, edges, focus.withColumn("focus", F.array(F.lit("Nobody"))))[0].count() == 0


def test_local_graphs(spark):
    docs = spark.createDataFrame([("n1", 0, "", "Acme Corp may raise prices soon."), ("n2", 1, "", "Acme Corp plans will delay orders. Acme Corp did protest loudly.")], "document_id string, ord int, title string, text string")
    q = spark.createDataFrame([("q", "What will Acme Corp plans raise or delay or protest?", ["Acme Corp"])], "query_id string, text string, focus_entities array<string>")
    events, edges = graphs.local_graph(q, docs)
    n = events.count()
    assert {r.event_id for r in events.collect()} == {f"e{k}" for k in range(n)} and n >= 2
    assert [r.edge_id for r in edges.orderBy("ord").collect()] == [f"edge{k}" for k in range(edges.count())]
    assert graphs.inference_sample(q, docs, max_events=1).count() == 1
    assert retrieval.empty_queries(spark.createDataFrame([("x", "zzz")], "query_id string, text string"), retrieval.retrieve(q, docs)).count() == 1


def test_samples_of_news(spark):
    q = spark.createDataFrame([("1", "What will Acme Corp raise?", ["7", "8", "7"]), ("2", "What will Acme Corp raise?", ["8"])], "query_id string, text string, docids array<string>")
    news = spark.createDataFrame([("7", 0, "Acme Corp will raise prices", "None."), ("8", 1, "Acme Corp will attack rivals", "None.")], "document_id string, ord int, title string, text string")
    got = {(r.sample_id, r.document_id) for r in graphs.news_samples(q, news).collect()}
    assert got == {("mirai_1", "7"), ("mirai_1", "8"), ("mirai_2", "8")}


GOLD = [
    {"id": "g1", "title": "t", "sentences": [["one", "two"], "three"], "tokens": [["one", "two"], ["three"]], "events": [{"id": x, "type": "T", "type_id": 1, "mention": [{"id": x, "trigger_word": f" w{x} ", "sent_id": k % 2, "offset": [0, 1] if k else []}]} for k, x in enumerate("abcd")],
     "causal_relations": {"PRECONDITION": [["b", "c"]], "CAUSE": [["a", "b"], ["a", "b"]]}, "temporal_relations": {"BEFORE": [["b", "c"], ["c", "d"]]}},
    {"id": "g2", "title": "t", "sentences": ["x"], "tokens": [["x"]], "events": [], "causal_relations": {}, "temporal_relations": {}},
]


def test_gold_samples(spark, tmp_path):
    (tmp_path / "valid.jsonl").write_text("\n".join(map(json.dumps, GOLD)))
    rows = C.gold_rows(spark, str(tmp_path), " Validation ")
    with pytest.raises(FileNotFoundError):
        C.gold_rows(spark, str(tmp_path), "test")
    events, edges = C.gold_samples(rows)
    told = {r.event_id: (r.text, r.normalized_text) for r in events.collect()}
    assert told["maven_e0"] == ("trigger=wa; mention=one two", "wa") and told["maven_e1"] == ("trigger=wb; mention=three", "wb")
    got = [(r.edge_id, r.source, r.target, r.relation_type, r.source_relation) for r in edges.orderBy("ord").collect()]
    assert got == [("gold_edge_0", "maven_e1", "maven_e2", "precedes", "PRECONDITION"), ("gold_edge_1", "maven_e0", "maven_e1", "causes", "CAUSE"), ("gold_edge_4", "maven_e2", "maven_e3", "precedes", "BEFORE")]
    assert metrics.in_scope(edges, "causal").count() == 2 and metrics.in_scope(edges, "all").count() == 3
    cut = C.gold_samples(rows, limit=1, max_events=2)
    assert {r.event_id for r in cut[0].collect()} == {"maven_e1", "maven_e2"} and cut[1].count() == 1
    events, edges = (spark.createDataFrame(t.collect(), t.schema) for t in (events, edges))
    sets = graphs.refinement_samples(events, edges, F.lit("a question"), F.lit(None).cast("string"))
    assert sets["nodes"].count() == 4 and len(sets["nodes"].columns) == 12
    labels = sets["labels"].collect()
    assert sets["edges"].count() == len(labels) >= 3 and sets["queries"].first().f3 == len(labels)
    assert len({(r.source, r.target) for r in labels if r.edge_label == 1}) == 3


def test_graph_files_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("q", "q", "what", None)], "sample_id string, query_id string, text string, cutoff_time string")
    docs = spark.createDataFrame([("q", 0, "d", "T")], "sample_id string, ord int, document_id string, title string")
    events = spark.createDataFrame([("q", 1, "e1", 0.5, {"trigger": "t", "is_title": "true"}), ("q", 0, "e0", 0.5, None)], "sample_id string, ord int, event_id string, confidence double, metadata map<string,string>")
    edges = spark.createDataFrame([("q", 0, "x", "e0", "e1", "causes", 0.25)], "sample_id string, ord int, edge_id string, source string, target string, relation_type string, score double")
    files.write_lines(files.graph_json(samples, docs, events, edges), str(tmp_path / "out"), "json")
    path = next(str(p) for p in (tmp_path / "out").glob("part-*") if p.stat().st_size)
    d, e, x = C.coarse_graphs(spark, path)
    assert [(r.event_id, r.trigger, r.is_title) for r in e.orderBy("ord").collect()] == [("e0", "", False), ("e1", "t", True)]
    assert d.first().title == "T" and (x.first().edge_id, x.first().score) == ("x", 0.25)
    timed = features.event_times(e.withColumn("publish_time", F.lit(None).cast("string")), F.lit(None).cast("string"))
    assert features.node_features(timed, F.lit("q")).count() == 2
    files.append_log(edges, str(tmp_path / "log"))
    files.append_log(edges, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    assert files.resolve("a/b", "/r") == "/r/a/b" and files.resolve("/a", "/r") == "/a" and files.resolve("s3://a", "/r") == "s3://a"
    assert [files.duration(s) for s in (7.4, 185, 3720)] == ["7s", "3m05s", "1h02m"]


def test_queries_by_hand_and_by_id(spark):
    q = C.ad_hoc_query(spark, "What will Acme Corp do in Rome?", "2030-01-01").first()
    assert (q.query_id, q.focus_entities) == ("query_001", ["Acme Corp", "Rome"])
    rows = spark.createDataFrame([("1", 0, "a"), ("1", 1, "b")], "query_id string, ord int, text string")
    assert C.query_by_id(rows, 1).first().text == "a"
    with pytest.raises(KeyError):
        C.query_by_id(rows, "2")


def test_small_reports(spark):
    rows = spark.createDataFrame([("s", k, a, kind, gold, p) for k, (a, kind, gold, p) in enumerate([("KEEP", "coarse", "KEEP", 0.9), ("DROP", "coarse", "DROP", 0.1), ("REJECT", "completion", "KEEP", 0.2), ("ADD", "completion", "DROP", 0.8), ("REJECT", "completion", "DROP", 0.3)])], "sample_id string, ord int, action string, source_kind string, gold_action string, keep_probability double")
    assert [r.ord for r in metrics.select_debug_edges(rows, 3).orderBy("ord").collect()] == [1, 2, 3]
    assert [r.ord for r in metrics.select_debug_edges(rows, 4).orderBy("ord").collect()] == [0, 1, 2, 3]
    assert metrics.select_debug_edges(rows, 0).count() == 5
    labels = spark.createDataFrame([("s", 1, "causes", 1), ("s", 0, "precedes", 0)], "sample_id string, edge_label int, label string, type_id int")
    assert {r.label: r.weight for r in metrics.class_weights(labels).collect()} == dict.fromkeys(("precedes", "causes", "escalates", "mitigates"))
    assert metrics.positive_weight(labels.where("edge_label = 0")).first().weight is None and metrics.positive_weight(labels).first().weight == 1.0
    s = metrics.edge_sample_stats(labels).first()
    assert (s.samples, s.edges, s.positive_edges, s.n_causes, s.positive_ratio) == (1, 2, 1, 1, 0.5)
    empty = metrics.run_rates(spark.createDataFrame([], "input_valid boolean, input_parsed boolean, forecast_parsed boolean, hit boolean, hit_with_alternatives boolean, reward double, events int, coarse_edges int, refined_edges int")).first()
    assert (empty.samples, empty.code_hit_rate, empty.average_reward, empty.event_extraction_parse_rate) == (0, 0.0, 0.0, None)
    events = spark.createDataFrame([("s", "a", 0, "A"), ("s", "b", 1, "B")], "sample_id string, event_id string, ord int, text string")
    scores = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.50001)], "sample_id string, event_id string, frontier_score double")
    assert [(r.rank, r.event_id) for r in graphs.rank_frontier(events, scores).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    c = spark.createDataFrame([("s", 0, "a", "b", "causes", 0.5, "x", {"k": "v", "action": "old"})], "sample_id string, ord int, source string, target string, relation_type string, score double, edge_id string, metadata map<string,string>")
    told = spark.createDataFrame([("s", 0, 0.9, "precedes", 0.7)], "sample_id string, ord int, keep_probability double, relation_type string, strength double")
    got = graph.refined_graph(c, told).first()
    assert (got.relation_type, got.score, got.metadata) == ("precedes", 0.7, {"k": "v", "action": "KEEP", "keep_probability": "0.9"})
    assert json.loads(graph.edge_payload(c).first().payload) == {"edges": [{"source_event_id": "a", "target_event_id": "b", "relation_type": "causes", "score": 0.5}]}
