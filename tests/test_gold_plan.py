"""Gold samples: an event takes its own sentence along, not all of its row's; the edges are computed once."""

from __future__ import annotations

from eventloom import queries
from eventloom.operators import steps
from eventloom.sources import corpora

DATA = "/root/testdata/sf0.001"


def test_events_are_picked_in_their_row(spark):
    plan = corpora.gold_graphs(queries._gold_rows(spark, DATA))[0].select("text", "evidence")._jdf.queryExecution().optimizedPlan().toString()
    assert any("Generate posexplode" in line and "gold_id" in line for line in plan.splitlines())


def test_edges_are_computed_once(spark, monkeypatch):
    def reads():
        return corpora.gold_samples(queries._gold_rows(spark, DATA), max_events=12)[1]._jdf.queryExecution().optimizedPlan().toString().count("Relation [")

    once = reads()
    monkeypatch.setattr(steps, "cut", lambda df: df)
    assert once < reads()
