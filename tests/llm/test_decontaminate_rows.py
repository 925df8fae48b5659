"""Decontamination of rows whose ids are null or repeated, and of short items."""

from __future__ import annotations

from eventloom.llm import decontaminate

ITEM = "what did the grey fox carry over the frozen river that night"


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_rows_are_judged_by_their_text(spark):
    rows = [(1, f"so {ITEM} ?"), (1, "another text under the same id that copies nothing at all"), (None, f"again {ITEM}"), (None, "clean text without an id"), (2, None)]
    docs, items = frames(spark, rows, [ITEM])
    assert sorted(map(tuple, decontaminate.clean(docs, items).collect()), key=str) == sorted([rows[1], rows[3], rows[4]], key=str)
