"""The pipeline's near-duplicate stage takes op8's SimHash classes as candidates."""

from __future__ import annotations

import numpy as np

import corpus_pipeline as pipeline
from eventloom.llm import minhash, simhash


def test_fingerprint_and_classes():
    codes = np.array([0b0111, 0b0101, 0b0001, 1 << 63], np.uint64)
    assert minhash.fingerprint(codes) == 0b0001 and minhash.fingerprint(codes[:0]) == 0 and minhash.fingerprint(codes[3:]) == -(1 << 63)
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 0, 1000)]
    assert minhash.linked(sets, [1, 1, 1]) == [[0, 1], [2]]  # a class is a candidate, similarity decides


def test_stage_runs_through_the_anchors(spark, monkeypatch):
    told = []
    monkeypatch.setattr(simhash, "links", lambda classes, bits=3, real=simhash.links: told.append(bits) or real(classes, bits))
    docs = spark.createDataFrame([(k, f"alpha beta gamma delta word{k // 2} zeta eta theta") for k in range(4)], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.without_near_copies(spark, docs, "").collect()) == [0, 2]
    assert told == [3]
