from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from eventloom.operators import graph, metrics, retrieval, sampling
from eventloom.plans import graphs, scorers
from eventloom.sources import corpora as C
from eventloom.sources import files
from eventloom.streaming import events as S

TAB = "\t"


def write(path, *rows):
    path.write_text("\n".join(TAB.join(r) for r in rows) + "\n")
    return str(path)


def test_queries_news_and_choices(spark, tmp_path):
    head = ["QueryId", "DateStr", "Actor1CountryName", "Actor2CountryName", "RelName", "EventBaseCode", "Docids", "AnswerList", "AnswerDict"]
    q = write(tmp_path / "q.csv", head, ["1", "2023-11-01", "A", "B", "Meet", "036", "['7', '8', '7']", "['036']", "{'036': ['0361']}"], ["2", "2023-11-02", "C", "D", "Host", "042", "oops", "[]", "x"])
    rows = {r.query_id: r for r in C.queries(spark, q).collect()}
    assert rows["1"].docids == ["7", "8", "7"] and rows["1"].answer_map == {"036": ["0361"]} and rows["1"].focus_entities == ["A", "B"]
    assert rows["2"].docids == [] and rows["2"].answer_map == {}
    assert C.queries(spark, q, limit=1).count() == 1 and C.queries(spark, q, limit=None).count() == 2
    head = ["Docid", "Title", "Text", "Abstract", "Date", "URL", "MD5"]
    n = write(tmp_path / "n.csv", head, ["8", "Eight", "The text", "The abstract", "2023-10-01", "u", "m"], ["7", "Seven", "First row", "", "2023-10-02", "u", "m"], ["7", "Seven again", "Second row", "", "2023-10-02", "u", "m"])
    got = retrieval.news_for_ids(C.queries(spark, q), C.news_table(spark, n)).orderBy("pos").collect()
    assert [(r.document_id, r.title, r.pos) for r in got] == [("7", "Seven", 0), ("8", "Eight", 1)]
    assert got[1].text == "The abstract\nThe text"
    k = write(tmp_path / "k.csv", ["EventBaseCode", "RelName"], ["042", "Host"], ["036", "Meet"], ["036", "Talk"], ["042", "Visit"], ["042", "Visit"], ["010", "Say"])
    got = retrieval.choice_vocabulary(C.event_code_rows(spark, k).repartition(1), 2).orderBy("choice_id").collect()
    assert [tuple(r) for r in got] == [("C001", "036", "Meet", 2), ("C002", "042", "Visit", 3)]


def test_archives_and_news_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/n.jsonl", json.dumps({"document_id": "1", "title": "T", "text": "x", "kept": 3}) + "\n\n")
    path = files.unpack(str(tmp_path / "a.zip"), "in/n.jsonl", str(tmp_path / "landing"))
    row = C.news_lines(spark, path).first()
    assert (row.document_id, row.source, json.loads(row.metadata)) == ("1", "unknown", {"kept": "3"})


def test_gold_graphs(spark, tmp_path):
    def event(i, sent):
        return {"id": i, "type": "x", "type_id": 1, "mention": [] if sent is None else [{"id": i, "trigger_word": f"w{i}", "sent_id": sent, "offset": [0, 1]}]}

    rows = [
        {"id": "d1", "title": "t", "sentences": ["one two", "three four"], "tokens": [["one", "two"], ["three", "four"]], "events": [event("a", 0), event("n", None), event("b", 1), event("far", 9), event("c", 1)],
         "causal_relations": {"CAUSE": [["a", "b"]], "PRECONDITION": [["b", "zz"]]}, "temporal_relations": {"BEFORE": [["a", "b"], ["b", "c"]]}},
        {"id": "d2", "title": "t", "sentences": ["one"], "tokens": [["one"]], "events": [event("a", 0)], "causal_relations": {}, "temporal_relations": {}},
    ]
    (tmp_path / "valid.jsonl").write_text("\n".join(map(json.dumps, rows)))
    events, edges = C.gold_graphs(C.gold_rows(spark, str(tmp_path), "dev"))
    assert [r.event_id for r in events.orderBy("ord").collect()] == ["maven_e0", "maven_e2", "maven_e4"]
    got = {(r.source, r.target, r.relation_type, r.score) for r in edges.collect()}
    assert got == {("maven_e0", "maven_e2", "causes", 1.0), ("maven_e0", "maven_e2", "precedes", 0.85), ("maven_e2", "maven_e4", "precedes", 0.85)}
    assert {(r.source, r.label) for r in graph.pair_labels(edges).collect()} == {("maven_e0", "causes"), ("maven_e2", "precedes")}
    assert {(r.source, r.label) for r in graph.last_labels(edges).collect()} == {("maven_e0", "precedes"), ("maven_e2", "precedes")}
    report = metrics.set_report(edges, edges.where("relation_type = 'causes'"), ["sample_id", "source", "target", "relation_type"]).first()
    assert (report.tp, report.fp, report.fn, report.precision) == (1, 0, 2, 1.0)


def test_coarse_graph_files(spark, tmp_path):
    bare = {"query": {"query_id": "q"}, "events": [{"event_id": "e1"}, {"event_id": "e2"}], "edges": [{"source_event_id": "e1", "target_event_id": "e2", "score": 0.9}, {"source_event_id": "e1", "target_event_id": "zz"}]}
    for value in (bare, {"coarse_graph": bare}):
        (tmp_path / "g.json").write_text(json.dumps(value, indent=1))
        _, events, edges = C.coarse_graphs(spark, str(tmp_path / "g.json"))
        assert events.count() == 2 and {r.node_type for r in events.collect()} == {"observed"}
        assert [(r.relation_type, r.score) for r in edges.orderBy("ord").collect()] == [("precedes", 0.9), ("precedes", 0.0)]


def test_scorers_and_sampling(spark):
    pairs = spark.createDataFrame([(1, k, "a truce", "b", k / 10) for k in range(10)], "sample_id int, ord int, s_text string, t_text string, candidate_score double")
    assert scorers.heuristic_scorer()(pairs).where("relation_type = 'mitigates'").count() == 10
    candidates = pairs.select("sample_id", "ord", F.lit("causes").alias("relation_type"), F.col("candidate_score").alias("score"), F.lit("coarse").alias("source_kind"))
    kept = {r.ord: r.keep_probability for r in scorers.prior_refiner()(candidates).collect()}
    assert kept[9] > kept[5] > kept[1] and abs(kept[5] - 1 / (1 + 2.718281828 ** -0.35)) < 1e-6
    rows = spark.range(100)
    for share, want in ((0.2, 20), (0.0, 1), (1.0, 99)):
        assert sampling.split(rows, "id", share).where("is_validation").count() == want
    drawn = sampling.synthetic_samples(spark.range(500).withColumnRenamed("id", "sample_id"))
    sizes = {r.sample_id: (int(r.f2), int(r.f3)) for r in drawn["queries"].collect()}
    assert {n for n, _ in sizes.values()} == {4, 5, 6, 7, 8} and all(n - 1 <= m <= min(2 * n, 12, n * (n - 1) // 2) for n, m in sizes.values())
    edges = drawn["edges"].toPandas()
    assert not edges.duplicated(["sample_id", "source", "target"]).any() and (edges["f7"] < edges["f8"]).all()
    assert edges.groupby("sample_id").size().to_dict() == {k: m for k, (_, m) in sizes.items()}
    assert drawn["nodes"].groupBy("sample_id").count().toPandas().set_index("sample_id")["count"].to_dict() == {k: n for k, (n, _) in sizes.items()}
    assert graphs.frontier(drawn["edges"].withColumns({"edge_id": F.lit("x"), "relation_type": F.lit("causes")})).where("rank = 1").count() == 500
    assert sampling.synthetic_samples(spark.range(0).withColumnRenamed("id", "sample_id"))["edges"].count() == 0


def test_streaming_counts(spark):
    folder = "/root/testdata/sf0.001"
    static = spark.read.parquet(f"{folder}/events.parquet")
    stream = S.windowed_counts(S.read_events(spark, folder, static.schema, "events.parquet"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counted").agg(F.sum("n")).first()[0] == static.count()
