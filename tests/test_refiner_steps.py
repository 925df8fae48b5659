"""The refiner's fused steps against the plain ones that they stand for."""

from __future__ import annotations

import math

import numpy as np

from eventloom import queries
from eventloom.models import tape as T
from eventloom.operators import sampling, steps


def test_fused_norm_and_layer():
    r = np.random.default_rng(0)
    values = [r.normal(size=s) for s in ((50, 30), (30,), (30,), (30, 16), (16,))]
    told = []
    for fused in (False, True):
        a, gain, shift, w, b = parts = [T.Var(v.copy()) for v in values]
        out = T.norm_linear(*parts) if fused else T.add(T.matmul(T.norm(a, gain, shift), w), b)
        T.backward(T.total(T.mul(out, out)))
        told.append([out.value, *[v.grad for v in parts]])
    for plain, got in zip(*told, strict=True):
        assert np.abs(plain - got).max() < 1e-12 * np.abs(plain).max()


def test_erf_and_segments():
    x = np.concatenate([np.linspace(-8, 8, 5001), [math.inf, -math.inf]])
    assert np.abs(T.erf(x) - [math.erf(v) for v in x]).max() < 4e-16 and np.isnan(T.erf(np.array([math.nan])))[0]
    r = np.random.default_rng(1)
    rows, seg, want = r.normal(size=(40, 3)), r.integers(0, 9, 40), np.zeros((12, 3))
    np.add.at(want, seg, rows)
    assert np.allclose(T._sums(rows, seg, 12), want, rtol=0, atol=1e-14) and not T._sums(rows[:0], seg[:0], 2).any()


def test_edges_are_drawn_once(spark, monkeypatch):
    cut, drawn = [], sampling.synthetic_samples
    monkeypatch.setattr(queries.steps, "cut", lambda df, real=steps.cut: cut.append(df.columns) or real(df))
    monkeypatch.setattr(queries.training, "train", lambda rows, weights, *_: type("S", (), {"weights": weights}))
    queries.trained_scores(spark, "/root/testdata/sf0.001")
    assert drawn(spark.range(1).toDF("sample_id"))["edges"].columns in cut
