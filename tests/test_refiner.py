"""The graph refiner against a plain version edge by edge, its gradients against differences, training against one process."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import queries as Q
from eventloom.adapters import QUERY
from eventloom.models import refiner as R
from eventloom.models import training as M
from eventloom.operators import features, graph, steps

DATA = "/root/testdata/sf0.001"
CONFIG = R.Config(hidden=8, steps=4)


def plain(w, nodes, links, query, steps):
    """One graph, node by node and edge by edge. links: (source, target, features)."""
    gelu = np.vectorize(lambda x: 0.5 * x * (1 + math.erf(x / math.sqrt(2))))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def norm(x, name):
        return (x - x.mean()) / np.sqrt(x.var() + 1e-5) * w[f"{name}.gain"] + w[f"{name}.shift"]

    def block(name, *parts):
        return gelu(norm(np.concatenate(parts), name) @ w[f"{name}.w1"] + w[f"{name}.b1"]) @ w[f"{name}.w2"] + w[f"{name}.b2"]

    def times(x):
        x = np.array(x)
        return block("time", x @ w["line.w"] + w["line.b"], np.sin(x @ w["wave.w"] + w["wave.b"]))

    def gated(name, x, old):
        a, b = np.split(x @ w[f"{name}_gate.w"] + w[f"{name}_gate.b"], 3), np.split(old @ w[f"{name}_gate.u"] + w[f"{name}_gate.c"], 3)
        r, z = sigmoid(a[0] + b[0]), sigmoid(a[1] + b[1])
        return norm((1 - z) * np.tanh(a[2] + r * b[2]) + z * old + old, f"{name}_norm")

    n, q = [block("node", np.array(x)) for x in nodes], block("query", np.array(query))
    kind = [int(f[1]) for _, _, f in links]
    there = [times([f[2], f[7], f[8], f[9], f[10], f[11]]) for _, _, f in links]
    again = [times([f[2], f[8], f[7], -f[9], f[10], -f[11]]) for _, _, f in links]
    e = [block("edge", block("scalar", np.array(f[:1] + f[2:])), t, w["relation"][k]) for (_, _, f), t, k in zip(links, there, kind)]

    def whole():
        return block("graph", np.mean(n, axis=0), np.mean(e, axis=0) if e else np.zeros(len(q)), q)

    def messages(name, typed, ends, when, c):
        told = [n[a] @ w[typed][k] for (a, _), k in zip(ends, kind)]
        gate = [block(f"{name}_gate", x, n[b], e[i], when[i], q, c)[0] for i, ((_, b), x) in enumerate(zip(ends, told))]
        out = [np.zeros(len(q)) for _ in n]
        for i, (_, b) in enumerate(ends):
            share = math.exp(gate[i]) / sum(math.exp(g) for g, (_, other) in zip(gate, ends) if other == b)
            out[b] = out[b] + share * block(name, told[i], n[b], e[i], q, c)
        return out

    for _ in range(steps if links else 0):
        c = whole()
        got = messages("message", "forth", [(s, t) for s, t, _ in links], there, c)
        more = messages("reply", "back", [(t, s) for s, t, _ in links], again, c)
        n = [gated("node", block("gathered", x @ w["itself"] + a + b, x, c), x) for x, a, b in zip(n, got, more)]
        c = whole()
        e = [gated("edge", block("edge_news", n[s], n[t], abs(n[s] - n[t]), e[i], there[i], q, c), e[i]) for i, (s, t, _) in enumerate(links)]
    c = whole()
    heads = []
    for i, (s, t, f) in enumerate(links):
        x = (n[s], n[t], abs(n[s] - n[t]), n[s] * n[t], e[i], there[i], q, c)
        p = min(max(f[0], 1e-4), 1 - 1e-4)
        heads.append((sigmoid(block("keep_head", *x)[0] + 0.5 * math.log(p / (1 - p)) + 0.35 * f[-2] - 0.25 * f[-1]), block("type_head", *x), sigmoid(block("strength_head", *x)[0])))
    return heads, [sigmoid(block("frontier_head", x, q, c, x * q)[0]) for x in n]


@pytest.fixture(scope="module")
def weights():
    return R.initial(CONFIG, 3)


@pytest.fixture(scope="module")
def rows(spark):
    e = steps.cut(features.event_times(Q._events(spark, DATA), F.lit("2024-01-20")))
    # every third edge counts as a completion
    kind = F.when(F.col("ord") % 3 == 0, "completion").otherwise("coarse")
    candidates = steps.cut(Q._coarse_of(e).withColumn("source_kind", kind))
    gold = graph.neighbour_edges(e)
    tables = features.node_features(e, F.lit(QUERY)), features.edge_features(candidates, e), features.query_features(e, candidates, F.lit(2))
    labels = features.labelled_samples(candidates.select("sample_id", "ord", "source", "target"), gold)
    out = M.graph_rows(*tables, labels)
    return spark.createDataFrame(out.toPandas(), out.schema).repartition(3).cache()


def test_network_is_the_plain_one(spark, rows, weights):
    # a graph without edges, one of a single node, and features of every kind
    got = M.predictions(rows, weights).collect()
    edges = {(r.sample_id, r.ord): r for r in got if r.ord is not None}
    nodes = {(r.sample_id, r.event_id): r.frontier_score for r in got if r.event_id is not None}
    some = rows.collect()
    assert sum(len(r.edges) for r in some) == len(edges) > 20 and sum(len(r.nodes) for r in some) == len(nodes)
    for r in some:
        at = {x.event_id: k for k, x in enumerate(r.nodes)}
        heads, frontier = plain(weights, [x.f for x in r.nodes], [(at[x.source], at[x.target], list(x.f)) for x in r.edges], r.query, 4)
        assert np.allclose(frontier, [nodes[r.sample_id, x.event_id] for x in r.nodes], atol=1e-10)
        for x, (keep, kind, strength) in zip(r.edges, heads, strict=True):
            told = edges[r.sample_id, x.ord]
            assert abs(told.keep_probability - keep) < 1e-10 and abs(told.strength - strength) < 1e-10
            assert told.relation_type == M.RELATIONS[int(np.argmax(kind))]


def test_graphs_without_edges_and_strange_rows(spark, weights):
    f = lambda n: ", ".join(f"f{k} double" for k in range(n))
    nodes = spark.createDataFrame([("a", "x", *[1.0] * 10), ("a", "y", *[None] * 10), ("b", "x", *[float("nan")] * 10)], "sample_id string, event_id string, " + f(10))
    edges = spark.createDataFrame([("a", 1, "x", "y", *[0.5] * 20), ("a", 2, "x", "gone", *[0.5] * 20), ("c", 1, "x", "y", *[0.5] * 20)], "sample_id string, ord int, source string, target string, " + f(20))
    queries = spark.createDataFrame([("a", *[1.0] * 6)], "sample_id string, " + f(6))
    got = M.predictions(M.graph_rows(nodes, edges, queries), weights).collect()
    assert [(r.sample_id, r.ord) for r in got if r.ord is not None] == [("a", 1)]
    scores = {(r.sample_id, r.event_id): r.frontier_score for r in got if r.event_id is not None}
    alone = plain(weights, [[0.0] * 10], [], [0.0] * 6, 4)[1][0]
    assert set(scores) == {("a", "x"), ("a", "y"), ("b", "x")} and abs(scores["b", "x"] - alone) < 1e-12
    empty = M.graph_rows(nodes.limit(0), edges, queries)
    assert M.predictions(empty, weights).count() == 0


def test_gradients(rows, weights):
    g = M.joined(rows.where(F.size("edges") > 0).limit(3).toPandas())
    objective = R.Objective(positive=2.5, kinds=(0.5, 1.0, 2.0, 0.25))
    _, gradient = R.losses(weights, g, 4, objective)
    draw = np.random.default_rng(1)
    for name, w in weights.items():
        way = draw.standard_normal(w.shape)
        ends = [R.losses(weights | {name: w + k * way}, g, 4, objective, False)[0][0] for k in (1e-6, -1e-6)]
        assert abs((ends[0] - ends[1]) / 2e-6 - float((gradient[name] * way).sum())) < 1e-5 * max(1.0, np.abs(gradient[name]).sum()), name


def test_losses_are_the_stated_ones(rows, weights):
    g = M.joined(rows.where(F.size("edges") > 0).limit(1).toPandas())
    o = R.Objective(positive=2.0, kinds=(0.5, 1.0, 2.0, 0.25))
    out = R.predict(weights, g, 4)
    p, y = out["keep"], g.keep
    keep = np.mean(-2.0 * y * np.log(p) - (1 - y) * np.log(1 - p))
    at = np.flatnonzero(y > 0.5)
    assert len(at) and len(at) < len(y)
    log = out["kind"][at] - np.log(np.exp(out["kind"][at]).sum(axis=1, keepdims=True))
    w = np.array(o.kinds)
    own = w[g.kind[at].astype(int)]
    kind = (0.98 * -(own * log[np.arange(len(at)), g.kind[at].astype(int)]).sum() + 0.02 / 4 * -(log * w).sum()) / own.sum()
    off = np.abs(out["strength"][at] - g.strength[at])
    strength = np.mean(np.where(off < 0.08, 0.5 * off**2 / 0.08, off - 0.04))
    density = (p.mean() - y.mean()) ** 2
    assert np.allclose(R.losses(weights, g, 4, o, False)[0], [keep + 0.7 * kind + 0.3 * strength + 0.08 * density, keep, kind, strength, density])


def test_training_is_that_of_one_process(spark, rows, weights, tmp_path):
    settings = M.Settings(epochs=3, lots=2, rate=1e-2)
    objective = M.objective_of(rows.select(F.explode("edges").alias("x")).select(F.col("x.keep").alias("edge_label"), F.col("x.kind").alias("type_id")))
    # one process: the same lots
    local = rows.where(F.size("edges") > 0).withColumn("lot", F.pmod(F.xxhash64(F.lit(settings.seed), F.col("sample_id")), F.lit(2))).toPandas()
    state = M.State.begin(dict(weights), settings)
    for epoch in range(3):
        seen = []
        for lot in np.random.default_rng([settings.seed, epoch]).permutation(2).tolist():
            some = local[local["lot"] == lot].reset_index(drop=True)
            if len(some):
                parts, gradient = R.losses(state.weights, M.joined(some), 4, objective)
                M.update(state, {k: v / len(some) for k, v in gradient.items()}, settings)
                seen.append(parts / len(some))
        state.history.append(np.mean(seen, axis=0))
    # one epoch, then a restart for the other two
    first = M.train(rows, weights, str(tmp_path / "t"), M.Settings(**{**settings.__dict__, "epochs": 1}), objective, rows)
    assert first.epoch == 1
    got = M.train(rows, weights, str(tmp_path / "t"), settings, objective, rows)
    assert got.epoch == 3 and [x["epoch"] for x in got.history] == [1, 2, 3] and got.history[0] == first.history[0]
    for name in weights:
        assert np.abs(got.weights[name] - state.weights[name]).max() < 1e-6
    assert np.allclose([x["loss"] for x in got.history], [x[0] for x in state.history], atol=1e-6)
    assert got.history[2]["loss"] < got.history[0]["loss"] and "val_loss" in got.history[2]
    # begun once more, nothing is left to do
    assert M.train(rows, weights, str(tmp_path / "t"), settings, objective, rows).updates == got.updates
    M.write_weights(spark, got.weights, str(tmp_path / "w"))
    read = M.read_weights(spark, str(tmp_path / "w"))
    assert all((read[k] == got.weights[k]).all() for k in weights)


def test_rate_is_cut_on_a_plateau(weights):
    settings = M.Settings(patience=1, rate=1.0)
    state = M.State.begin(weights, settings)
    assert [M.plateau(state, x, settings) for x in (1.0, 0.5, 0.5, 0.49999, 0.4)] == [True, True, False, False, True]
    assert state.rate == 0.5


def test_refined_graph_by_the_network(spark, weights):
    e = steps.cut(features.event_times(Q._events(spark, DATA), F.lit("2024-01-20")))
    c = steps.cut(Q._coarse_of(e).withColumns({"source_kind": F.lit("coarse"), "edge_id": F.concat(F.lit("edge_"), F.col("ord").cast("string"))}))
    scores = steps.cut(M.network_refiner(weights, e, F.lit(QUERY), F.lit(2))(c))
    out = graph.refined_graph(c, scores, 0.4).collect()
    assert scores.count() == c.count() and len(out) == scores.where("keep_probability >= 0.4").count() > 0
