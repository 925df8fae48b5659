"""A graph refiner: typed messages both ways along candidate edges, gated updates of nodes and edges, heads for edges and nodes.

Many graphs are computed at once as one graph that falls into parts: rows of all nodes and of all edges, and for each row the graph it
belongs to. Numbers are doubles. Weights are a dict of arrays by name; Parquet tables hold them as (name, shape, values).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import tape as T
from .tape import Var

NODE, EDGE, QUERY, RELATIONS = 10, 20, 6, 4
# fixed values: places of the times among an edge's features (score of order, times of both ends, change, size of change, change of
# sentence), how they stand and which change sign when the edge is read backwards; weights of the prior
TIMES = [2, 7, 8, 9, 10, 11]
BACKWARDS, SIGNS = [0, 2, 1, 3, 4, 5], np.array([1.0, 1.0, 1.0, -1.0, 1.0, -1.0])
PRIOR, COARSE, COMPLETION = 0.5, 0.35, 0.25


@dataclass
class Config:
    hidden: int = 192
    steps: int = 4


@dataclass
class Graphs:
    """Graphs side by side; labels are there for training only."""

    nodes: np.ndarray
    node_graph: np.ndarray
    edges: np.ndarray
    source: np.ndarray
    target: np.ndarray
    edge_graph: np.ndarray
    query: np.ndarray
    keep: np.ndarray | None = None
    kind: np.ndarray | None = None
    strength: np.ndarray | None = None


def layout(config: Config) -> dict[str, tuple[int, ...]]:
    """Shape of each weight by name."""
    h, relation = config.hidden, max(config.hidden // 4, 16)
    blocks = {
        "node": (NODE, h), "scalar": (EDGE - 1, h), "query": (QUERY, h), "time": (2 * h, h), "edge": (2 * h + relation, h),
        "message": (5 * h, h), "reply": (5 * h, h), "message_gate": (6 * h, 1), "reply_gate": (6 * h, 1), "gathered": (3 * h, h), "graph": (3 * h, h), "edge_news": (7 * h, h),
        "keep_head": (8 * h, 1), "type_head": (8 * h, RELATIONS), "strength_head": (8 * h, 1), "frontier_head": (4 * h, 1),
    }
    out: dict[str, tuple[int, ...]] = {}
    for name, (wide, to) in blocks.items():
        out |= {f"{name}.gain": (wide,), f"{name}.shift": (wide,), f"{name}.w1": (wide, h), f"{name}.b1": (h,), f"{name}.w2": (h, to), f"{name}.b2": (to,)}
    for name in ("line", "wave"):
        out |= {f"{name}.w": (len(TIMES), h), f"{name}.b": (h,)}
    for name in ("node_gate", "edge_gate"):
        out |= {f"{name}.w": (h, 3 * h), f"{name}.b": (3 * h,), f"{name}.u": (h, 3 * h), f"{name}.c": (3 * h,)}
    for name in ("node_norm", "edge_norm"):
        out |= {f"{name}.gain": (h,), f"{name}.shift": (h,)}
    return out | {"relation": (RELATIONS, relation), "forth": (RELATIONS, h, h), "back": (RELATIONS, h, h), "itself": (h, h)}


def initial(config: Config, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights to begin with: gains one, vectors and tables of vectors small, matrices by their number of inputs."""
    draw, out = np.random.default_rng(seed), {}
    for name, shape in layout(config).items():
        if name.endswith("gain"):
            out[name] = np.ones(shape)
        elif name.endswith("shift"):
            out[name] = np.zeros(shape)
        elif name == "relation":
            out[name] = draw.standard_normal(shape)
        else:
            bound = 1.0 / np.sqrt(shape[-2] if len(shape) > 1 else config.hidden)
            out[name] = draw.uniform(-bound, bound, shape)
    return out


class _Net:
    """The computation over weights on the tape."""

    def __init__(self, weights: dict[str, Var]) -> None:
        self.w = weights

    def linear(self, x: Var, w: str, b: str) -> Var:
        return T.add(T.matmul(x, self.w[w]), self.w[b])

    def block(self, name: str, *parts: Var) -> Var:
        """Norm, a layer, gelu, a layer."""
        x = T.norm_linear(T.cat(*parts), *[self.w[f"{name}.{part}"] for part in ("gain", "shift", "w1", "b1")])
        return self.linear(T.gelu(x), f"{name}.w2", f"{name}.b2")

    def times(self, rows: np.ndarray) -> Var:
        x = Var(rows)
        return self.block("time", self.linear(x, "line.w", "line.b"), T.sin(self.linear(x, "wave.w", "wave.b")))

    def gated(self, name: str, news: Var, state: Var) -> Var:
        """What is kept of a state, and what news replaces; then added to the state and brought to a norm."""
        h = state.value.shape[1]
        x, s = self.linear(news, f"{name}_gate.w", f"{name}_gate.b"), self.linear(state, f"{name}_gate.u", f"{name}_gate.c")
        part = lambda v, k: T.columns(v, k * h, (k + 1) * h)
        reset, old = T.sigmoid(T.add(part(x, 0), part(s, 0))), T.sigmoid(T.add(part(x, 1), part(s, 1)))
        new = T.tanh(T.add(part(x, 2), T.mul(reset, part(s, 2))))
        out = T.add(T.mul(T.scaled(old, -1.0, 1.0), new), T.mul(old, state))
        return T.norm(T.add(out, state), self.w[f"{name}_norm.gain"], self.w[f"{name}_norm.shift"])

    def run(self, g: Graphs, steps: int) -> dict[str, Var]:
        """keep (logits), kind (logits), strength by edge; frontier by node."""
        n, graphs = len(g.nodes), len(g.query)
        node, query = self.block("node", Var(g.nodes)), self.block("query", Var(g.query))
        kind = np.clip(np.rint(g.edges[:, 1]), 0, RELATIONS - 1).astype(int)
        forward = g.edges[:, TIMES]
        time, backward_time = self.times(forward), self.times(forward[:, BACKWARDS] * SIGNS)
        edge = self.block("edge", self.block("scalar", Var(np.delete(g.edges, 1, axis=1))), time, T.take(self.w["relation"], kind))
        query_of_edge, query_of_node = T.take(query, g.edge_graph), T.take(query, g.node_graph)
        # graphs without an edge pass no messages: their nodes stay as they are
        linked = (np.bincount(g.edge_graph, minlength=graphs) > 0)[g.node_graph][:, None].astype(float)

        def whole() -> Var:
            return self.block("graph", T.seg_mean(node, g.node_graph, graphs), T.seg_mean(edge, g.edge_graph, graphs), query)

        def sent(name: str, typed: str, start: np.ndarray, end: np.ndarray, when: Var, about: Var) -> Var:
            """Messages from start to end, weighed among those that an end gets, and added up."""
            told = T.typed_matmul(T.take(node, start), self.w[typed], kind)
            rest = T.take(node, end)
            share = T.seg_softmax(self.block(f"{name}_gate", told, rest, edge, when, query_of_edge, about), end, n)
            return T.seg_sum(T.mul(self.block(name, told, rest, edge, query_of_edge, about), share), end, n)

        for _ in range(steps if len(g.edges) else 0):
            graph = whole()
            about = T.take(graph, g.edge_graph)
            got = T.add(sent("message", "forth", g.source, g.target, time, about), sent("reply", "back", g.target, g.source, backward_time, about))
            got = self.block("gathered", T.add(T.matmul(node, self.w["itself"]), got), node, T.take(graph, g.node_graph))
            node = T.add(T.scaled(self.gated("node", got, node), linked), T.scaled(node, 1.0 - linked))
            about = T.take(whole(), g.edge_graph)
            s, t = T.take(node, g.source), T.take(node, g.target)
            edge = self.gated("edge", self.block("edge_news", s, t, T.absolute(T.add(s, T.scaled(t, -1.0))), edge, time, query_of_edge, about), edge)
        graph = whole()
        s, t = T.take(node, g.source), T.take(node, g.target)
        seen = (s, t, T.absolute(T.add(s, T.scaled(t, -1.0))), T.mul(s, t), edge, time, query_of_edge, T.take(graph, g.edge_graph))
        score = np.clip(g.edges[:, :1], 1e-4, 1.0 - 1e-4)
        prior = PRIOR * np.log(score / (1.0 - score)) + COARSE * g.edges[:, -2:-1] - COMPLETION * g.edges[:, -1:]
        return {
            "keep": T.scaled(self.block("keep_head", *seen), 1.0, prior), "kind": self.block("type_head", *seen), "strength": T.sigmoid(self.block("strength_head", *seen)),
            "frontier": T.sigmoid(self.block("frontier_head", node, query_of_node, T.take(graph, g.node_graph), T.mul(node, query_of_node))),
        }


def predict(weights: dict[str, np.ndarray], graphs: Graphs, steps: int) -> dict[str, np.ndarray]:
    """keep (probability), kind (logits), strength by edge; frontier by node."""
    out = _Net({k: Var(v) for k, v in weights.items()}).run(graphs, steps)
    got = {k: v.value for k, v in out.items()}
    return {"keep": 0.5 * (1.0 + np.tanh(0.5 * got["keep"][:, 0])), "kind": got["kind"], "strength": got["strength"][:, 0], "frontier": got["frontier"][:, 0]}


@dataclass
class Objective:
    """Weights of the losses: kept edges, types and strengths of edges to be kept, and the share kept of a graph."""

    keep: float = 1.0
    kind: float = 0.7
    strength: float = 0.3
    density: float = 0.08
    positive: float = 1.0  # weight of an edge to be kept
    kinds: tuple[float, ...] | None = None  # weight of each type
    smoothing: float = 0.02
    beta: float = 0.08


PARTS = ("loss", "keep", "kind", "strength", "density")


def _losses(out: dict[str, Var], g: Graphs, o: Objective) -> dict[str, Var]:
    """Sums over graphs of each graph's losses, which are means over its edges."""
    graphs, wanted = len(g.query), g.keep.reshape(-1, 1)
    per_edge = (1.0 / np.bincount(g.edge_graph, minlength=graphs)[g.edge_graph])[:, None]
    # -y log p - (1 - y) log(1 - p)
    cross = T.add(T.scaled(T.softplus(T.scaled(out["keep"], -1.0)), o.positive * wanted), T.scaled(T.softplus(out["keep"]), 1.0 - wanted))
    parts = {"keep": T.total(T.scaled(cross, per_edge))}
    off = T.seg_sum(T.scaled(T.sigmoid(out["keep"]), per_edge, -wanted * per_edge), g.edge_graph, graphs)
    parts["density"] = T.total(T.mul(off, off))
    at = np.flatnonzero(g.keep > 0.5)
    of, kind = g.edge_graph[at], g.kind[at].astype(int)
    weights = np.array(o.kinds or (1.0,) * RELATIONS)
    weighed = np.bincount(of, weights[kind], minlength=graphs)[of]
    # the weight that the label's type has, a little of it spread over all types
    aim = (1.0 - o.smoothing) * np.eye(RELATIONS)[kind] * weights + o.smoothing / RELATIONS * weights
    aim = np.divide(aim, weighed[:, None], out=np.zeros_like(aim), where=weighed[:, None] > 0)
    parts["kind"] = T.total(T.scaled(T.log_softmax(T.take(out["kind"], at)), -aim))
    share = (1.0 / np.maximum(np.bincount(of, minlength=graphs), 1)[of])[:, None]
    parts["strength"] = T.total(T.scaled(T.smooth_l1(T.scaled(T.take(out["strength"], at), 1.0, -g.strength[at].reshape(-1, 1)), o.beta), share))
    parts["loss"] = T.add(T.add(T.scaled(parts["keep"], o.keep), T.scaled(parts["kind"], o.kind)), T.add(T.scaled(parts["strength"], o.strength), T.scaled(parts["density"], o.density)))
    return parts


def losses(weights: dict[str, np.ndarray], graphs: Graphs, steps: int, objective: Objective, gradients: bool = True) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(sums over graphs of the PARTS, gradients of the loss by name). Graphs have an edge each."""
    told = {k: Var(v) for k, v in weights.items()}
    parts = _losses(_Net(told).run(graphs, steps), graphs, objective)
    if gradients:
        T.backward(parts["loss"])
    return np.array([float(parts[p].value) for p in PARTS]), {k: v.grad if v.grad is not None else np.zeros_like(v.value) for k, v in told.items()} if gradients else {}
