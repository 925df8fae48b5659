from __future__ import annotations

import copy
import json

import pytest
from pyspark.sql import functions as F

from eventloom.operators import pairs
from eventloom.sources import event_input as E
from eventloom.sources import files

BOARD = ["Harbor Board"]
RECORD = {
    "query_id": "storm",
    "query": {"query_id": "storm", "text": "Which harbor reopened?", "focus_entities": ["Harbor Board"]},
    "documents": [
        {"document_id": "bulletin", "title": "Bulletin", "text": "The harbor closed early. Later the harbor reopened.", "published_at": "2031-04-30", "metadata": {"page": 3}},
        {"document_id": "ledger", "text": "Fees were paid."},
    ],
    "events": [
        {"event_id": "shut", "trigger": "closed", "event": "harbor closed early", "doc_id": "bulletin", "participants": BOARD, "confidence": 0.8, "metadata": {"page": 3, "publish_time": "2031-04-29"}},
        {"event_id": "open", "text": "Trigger=reopened; Mention=harbor reopened ", "document_id": "bulletin", "sentence_index": 1, "participants": [*BOARD, "Pilots"], "evidence": ["", "Later the harbor reopened."]},
        {"event_id": "paid", "metadata": {"trigger": "paid", "event_context": "fees  paid"}, "document_id": "ledger", "evidence": {"doc_id": "ledger", "sentence": "Fees were paid.", "sentence_index": 4}},
    ],
}


def write(tmp_path, *records, name="in.jsonl"):
    path = tmp_path / name
    path.write_text("\n\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
    return str(path)


def changed(where, value):
    record = copy.deepcopy(RECORD)
    at = record
    for key in where[:-1]:
        at = at[key]
    at[where[-1]] = value
    return record


def test_parses_and_materialises(spark, tmp_path):
    docs, events = E.materialise(E.load(spark, write(tmp_path, RECORD)).persist())
    rows = {r.event_id: r for r in events.collect()}
    assert {k: r.text for k, r in rows.items()} == {"shut": "trigger=closed; mention=harbor closed early", "open": "trigger=reopened; mention=harbor reopened", "paid": "trigger=paid; mention=fees paid"}
    assert [tuple(e) for e in rows["shut"].evidence] == [("bulletin", 0, "harbor closed early")]
    assert [tuple(e) for e in rows["open"].evidence] == [("bulletin", 1, "Later the harbor reopened.")]
    assert [tuple(e) for e in rows["paid"].evidence] == [("ledger", 4, "Fees were paid.")]
    assert (rows["shut"].confidence, rows["open"].confidence, rows["shut"].event_time_text, rows["open"].publish_time) == (0.8, 1.0, "2031-04-29", "2031-04-30")
    assert rows["shut"].metadata == {"page": "3", "publish_time": "2031-04-29", "trigger": "closed", "event_mention": rows["shut"].text, "event_context": "harbor closed early", "event_input_schema": E.VERSION}
    assert {r.document_id: (r.source, r.metadata) for r in docs.collect()} == {"bulletin": ("preextracted", '{"page":3}'), "ledger": ("preextracted", None)}


MUTATIONS = [
    (("events", 2, "event_id"), "open", "repeated event_id"),
    (("events", 1, "document_id"), "nowhere", "unknown document"),
    (("edges",), [{"any": "edge"}], "edges are not allowed"),
    (("schema_version",), "event-input-v0", "schema_version"),
    (("query", "query_id"), "calm", "query_id differs"),
    (("query", "text"), " ", "query needs"),
    (("documents", 1, "document_id"), "bulletin", "repeated document_id"),
    (("documents",), "bulletin", "must be an array"),
    (("documents",), [7], "must be an object"),
    (("documents", 0, "metadata"), [], "must be an object"),
    (("events",), [], "no events"),
    (("events",), {"event_id": "shut"}, "must be an array"),
    (("events", 0), "shut", "must be an object"),
    (("events", 0, "metadata"), "m", "must be an object"),
    (("events", 0, "participants"), "Harbor Board", "must be an array"),
    (("events", 0, "sentence_index"), -2, "sentence_index"),
    (("events", 0, "sentence_index"), "first", "sentence_index"),
    (("events", 0, "sentence_index"), None, "sentence_index"),
    (("events", 0, "confidence"), 1.01, "confidence"),
    (("events", 0, "confidence"), "sure", "confidence"),
    (("events", 0, "evidence"), [{"document_id": "nowhere", "text": "t"}], "unknown document"),
    (("events", 0, "evidence"), [{"document_id": "bulletin"}], "evidence needs"),
    (("events", 0, "evidence"), [5], "evidence must be"),
    (("events", 0, "trigger"), "  ", "trigger and mention"),
    (("query",), ["text"], "must be an object"),
]


def test_rules(spark, tmp_path):
    path = write(tmp_path, RECORD, *[changed(where, value) for where, value, _ in MUTATIONS])
    quarantined = {r.ord: r.errors for r in E.rejected(spark, path).collect()}
    assert sorted(quarantined) == [2 * k + 3 for k in range(len(MUTATIONS))]
    for k, (where, value, message) in enumerate(MUTATIONS):
        assert any(message in e for e in quarantined[2 * k + 3]), (where, value, quarantined[2 * k + 3])
    with pytest.raises(E.InvalidInput, match="in.jsonl:3 .*repeated event_id"):
        E.load(spark, path)
    assert E.load(spark, path, "QUARANTINE").count() == 1


def test_containers_and_bad_json(spark, tmp_path):
    def errors(value):
        return [list(r.errors) for r in E.validate(E.read_raw(spark, write(tmp_path, value, name="in.json"))).select("errors").collect()]

    assert errors([RECORD, 1]) == [[], ["not a JSON object", "query_id is required"]]
    assert errors({"samples": [RECORD]}) == [[]] and errors(RECORD) == [[]] and errors("[]") == []
    assert all(len(errors(text)[0]) > 0 for text in ('{"samples": 3}', "no"))
    with pytest.raises(E.InvalidInput, match="in.jsonl:3"):
        E.load(spark, write(tmp_path, RECORD, "{bad"))


def test_lines_are_counted_over_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 700), ("b.jsonl", 30)):
        (tmp_path / name).write_text("".join(f"line {k} {'x' * 50}\n" if k % 3 else "\n" for k in range(1, n + 1)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.numbered_lines(spark, str(tmp_path / "*.jsonl"))
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 467 + 20 and all(r.value.startswith(f"line {r.line} ") for r in got)


def test_index_select_and_summary(spark, tmp_path):
    second = changed(("query_id",), "calm")
    second["query"]["query_id"] = "calm"
    del second["documents"]
    records = E.load(spark, write(tmp_path, RECORD, second)).persist()
    assert {r.query_id: r.record.sample_id for r in E.index(records).collect()} == {"storm": "events_storm", "calm": "events_calm"}
    assert E.select_record(records, "calm").first().sample_id == "events_calm"
    for query_id in (None, "none"):
        with pytest.raises(E.InvalidInput):
            E.select_record(records, query_id)
    with pytest.raises(E.InvalidInput, match="repeated query_id"):
        E.load(spark, write(tmp_path, RECORD, RECORD, name="twice.jsonl"))
    s = E.summary(records).first()
    assert (s.records, s.events, list(s.query_ids), s.with_query, s.with_documents) == (2, 6, ["storm", "calm"], 2, 1)


def test_context_from_tables(spark, tmp_path):
    bare = {k: v for k, v in RECORD.items() if k != "documents"}
    records = E.load(spark, write(tmp_path, bare)).persist()
    with pytest.raises(E.InvalidInput, match="lacks a query or documents"):
        E.materialise(records)
    q = spark.createDataFrame([("storm", "from the table", "2031-05-01", ["X"])], "query_id string, text string, cutoff_time string, focus_entities array<string>")
    d = spark.createDataFrame([("storm", k, n, "t", "x", None, "s") for k, n in enumerate(("bulletin", "ledger", "extra"))], "query_id string, ord int, document_id string, title string, text string, publish_time string, source string")
    docs, events = E.materialise(E.with_context(records, q, d))
    assert docs.count() == 3 and {(r.query, r.cutoff_time) for r in events.collect()} == {("from the table", "2031-05-01")}
    own = E.with_context(E.load(spark, write(tmp_path, RECORD, name="own.jsonl")), q, d).persist()
    assert {r.query for r in E.materialise(own)[1].collect()} == {RECORD["query"]["text"]}
    with pytest.raises(E.InvalidInput, match="unknown document ledger"):
        E.materialise(own, max_docs=1)
    assert E.materialise(own, max_events=2)[1].count() == 2
    with pytest.raises(E.InvalidInput, match="under two"):
        E.materialise(own, max_events=1)


def test_one_event_is_too_few(spark, tmp_path):
    records = E.load(spark, write(tmp_path, changed(("events",), RECORD["events"][:1]))).persist()
    with pytest.raises(E.InvalidInput, match="under two"):
        E.materialise(records)


def test_pair_scores(spark, tmp_path):
    _, events = E.materialise(E.load(spark, write(tmp_path, RECORD)).persist())
    rows = pairs.with_tokens(events, F.col("query"))
    got = {(r.s_event_id, r.t_event_id): r for r in pairs.inference_pairs(rows, max_gap=1, max_pairs=0).collect()}
    # one document, one sentence apart, 3 of 6 words, 1 participant, 1 of 7 and 2 of 5 words of the query
    want = 0.35 + 0.25 / 2 + 0.20 * 3 / 6 + 0.10 / 3 + 0.10 * (1 / 7 + 2 / 5) / 2
    assert got["shut", "open"].candidate_score == pytest.approx(want) == got["open", "shut"].candidate_score
    assert got["shut", "open"].score == 0.49
    # other documents: enough words shared
    assert got["open", "paid"].score == pytest.approx(round(0.25 / 2 + 0.20 * 2 / 6 + 0.10 * (2 / 5 + 0) / 2, 4))
    with pytest.raises(ValueError, match="more than 2 events"):
        pairs.checked(rows, 2)
    assert pairs.checked(rows, 3) is rows
