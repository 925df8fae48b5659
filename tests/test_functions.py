from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as X
from eventloom.functions import values as V
from eventloom.operators import graph, retrieval


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: X.tokenize(F.lit("It's A-b 9!")), ["it's", "a", "b", "9"]),
        (lambda: X.normalize(F.lit("The bank of Rome")), "bank rome"),
        (lambda: X.sentences(F.lit("One. Two!  Three? 1 four")), ["One.", "Two!", "Three?", "1 four"]),
        (lambda: X.clauses(F.lit("The bank raised rates and the workers protested; so")), ["The bank raised rates", "the workers protested"]),
        (lambda: X.clauses(F.lit("Too short")), ["Too short"]),
        (lambda: X.titlecase_entities(F.lit("What did Central Bank do in Paris, Central Bank?")), ["Central Bank", "Paris"]),
        (lambda: X.event_mention(F.lit("a"), F.lit("x " * 200)), "trigger=a; mention=" + ("x " * 200)[:177].rstrip() + "..."),
        (lambda: X.stem(F.lit("warning")), "warn"),
        (lambda: X.stem(F.lit("raised")), "rais"),
        (lambda: X.trigger(F.lit("They reported that workers protested")), "protest"),
        (lambda: X.trigger(F.lit("nothing here")), None),
        (lambda: X.has_marker(F.lit("it was called"), ["led"]), True),
        (lambda: X.relation(F.lit("a truce"), F.lit("an attack")), "mitigates"),
        (lambda: X.relation(F.lit("a b"), F.lit("attacks")), "escalates"),
        (lambda: X.relation(F.lit("a b"), F.lit("because")), "causes"),
        (lambda: X.clean_document(F.lit("Title"), F.lit("Title\nBy John Doe\n\nReal news\nreal NEWS\nSource: x\nMore things happened")), "Real news\nMore things happened"),
        (lambda: X.is_generic(F.lit("relations worsen in the area")), True),
        (lambda: X.is_generic(F.lit("the bank raises its rate")), False),
        (lambda: X.relative_time_score(F.lit(" T - 3")), 1.0),
        (lambda: X.relative_time_score(F.lit("t-0")), 0.0),
        (lambda: X.relative_time_score(F.lit("just before it")), 0.6),
        (lambda: V.days_since_epoch(F.lit("2025-01-30")), 20118.0),
        (lambda: V.days_since_epoch(F.lit("2025/01")), 20089.0),
        (lambda: V.days_since_epoch(F.lit("1970")), 0.0),
        (lambda: V.days_since_epoch(F.lit("soon")), None),
        (lambda: V.first_json_object(F.lit('so {"a": "}\\"{", "b": {"c": 1}} end')), '{"a": "}\\"{", "b": {"c": 1}}'),
        (lambda: V.first_json_object(F.lit("{broken")), None),
        (lambda: V.literal_list(F.lit("['a', 2]")), ["a", "2"]),
        (lambda: V.literal_list(F.lit("nope")), []),
        (lambda: V.first_json_object(F.lit('{broken} then {"a": 1}')), None),
        (lambda: V.json_answer(F.lit('It {is}.\n```json\n{"a": {"b": 1}}\n``` so')), '{"a": {"b": 1}}'),
        (lambda: V.json_answer(F.lit("[1]")), None),
        (lambda: V.outer_json(F.lit('so {"a": {"b": 1}} and')), '{"a": {"b": 1}}'),
        (lambda: V.literal_list(F.lit("('a', 'b')")), []),
        (lambda: V.literal_map(F.lit("{'a': 'b', 'c': ['d', None], 'e': None, 2: (1,)}")), {"a": ["b"], "c": ["d", "None"], "2": ["(1,)"]}),
        (lambda: V.texts(V.field(F.try_parse_json(F.lit('{"a": null, "b": ["x", 2, ""]}')), "a", "b")), ["x", "2"]),
        (lambda: V.is_true(F.try_parse_json(F.lit('"0"'))), True),
        (lambda: V.is_true(F.try_parse_json(F.lit("0.0"))), False),
        (lambda: X.sentences(F.lit("\n One. Two!\n\nThree\n")), ["One.", "Two!", "Three"]),
        (lambda: X.compact(F.lit("a  b"), 0), "a b"),
        (lambda: X.display_trigger(F.lit(" "), F.lit("trigger=met; mention=they met")), "met"),
        (lambda: X.locate_sentence(F.lit("A title"), F.lit("First one. They met there."), F.lit("met there"))["sentence_index"], 2),
        (lambda: X.locate_sentence(F.lit("The"), F.lit("First one."), F.lit("met"))["sentence"], "The"),
        (lambda: X.locate_sentence(F.lit("Title"), F.lit("First one."), F.lit(""))["sentence"], "Title"),
        (lambda: X.clean_document(F.lit(None).cast("string"), F.lit("b c\na\nA\nb  c\nc")), "b c\nc"),
        (lambda: V.pair_payload(F.lit('{"relation_type": "Causes", "score": 3}'))["score"], 1.0),
        (lambda: V.pair_payload(F.lit('{"relation_type": "unknown"}')), None),
    ],
)
def test_functions(spark, make, want):
    assert value(spark, make()) == want


def test_retrieval_and_events(spark):
    docs = spark.createDataFrame(
        [("n1", 0, "Rates", "The Central Bank raised rates. Manufacturers warn of delay in plans and close plants."), ("n2", 1, "Manufacturers plan cuts", "Nothing else."), ("n3", 2, "Sports", "A game.")],
        "document_id string, ord int, title string, text string",
    )
    queries = spark.createDataFrame([("q", "What may manufacturers do after the Central Bank raises rates?")], "query_id string, text string")
    hits = retrieval.retrieve(queries, docs)
    assert {r.document_id for r in hits.collect()} == {"n1", "n2"}
    from eventloom.plans.graphs import local_graph

    events, edges = local_graph(queries, docs)
    got = [r.asDict() for r in events.orderBy("ord").collect()]
    assert [e["event_id"] for e in got] == [f"e{k}" for k in range(len(got))] and len(got) >= 2
    assert {e["trigger"] for e in got} <= {"warn", "plan", "close", "delay"}
    assert all(e["score"] >= 0.24 for e in got) and edges.count() == len(got) - len({e["document_id"] for e in got})


def test_best_path_is_bounded_and_terminal(spark):
    edges = spark.createDataFrame([(1, "a", "b", 0.9), (1, "b", "c", 0.9), (1, "a", "c", 0.5), (1, "c", "d", 1.0), (1, "b", "a", 1.0)], "sample_id int, source string, target string, weight double")
    starts = spark.createDataFrame([(1, "a")], "sample_id int, node string")
    targets = spark.createDataFrame([(1, "c"), (1, "d"), (1, "a")], "sample_id int, node string")
    got = {r.target: round(r.score, 6) for r in graph.best_paths(edges, starts, targets).collect()}
    assert got == {"c": 0.81, "a": 0.9}  # d lies behind c, which ends paths; a counts when it is come back to
