"""Gradients of small numpy computations: each step keeps what its derivative needs, backward() walks the steps in reverse.

It has the steps that the graph refiner is made of, and no others. Rows are nodes, edges or graphs; seg tells for each row where it belongs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np


class Var:
    """A value, and how its derivative goes to what it came from."""

    __slots__ = ("back", "grad", "value")

    def __init__(self, value: np.ndarray, back: list[tuple[Var, Callable]] | None = None) -> None:
        self.value, self.back, self.grad = value, back or [], None


def backward(top: Var) -> None:
    """Sets grad of everything that top, one number, came from."""
    order, seen, todo = [], set(), [(top, False)]
    while todo:
        node, done = todo.pop()
        if done:
            order.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            todo.append((node, True))
            todo.extend((parent, False) for parent, _ in node.back)
    top.grad = np.ones_like(top.value)
    for node in reversed(order):
        for parent, share in node.back:
            got = share(node.grad)
            parent.grad = got if parent.grad is None else parent.grad + got


def _fit(grad: np.ndarray, shape: tuple) -> np.ndarray:
    """The derivative of a value that was stretched to grad's shape."""
    grad = grad.sum(axis=tuple(range(grad.ndim - len(shape))))
    return grad.sum(axis=tuple(k for k, n in enumerate(shape) if n == 1 and grad.shape[k] != 1), keepdims=True)


def add(a: Var, b: Var) -> Var:
    return Var(a.value + b.value, [(a, lambda g: _fit(g, a.value.shape)), (b, lambda g: _fit(g, b.value.shape))])


def mul(a: Var, b: Var) -> Var:
    return Var(a.value * b.value, [(a, lambda g: _fit(g * b.value, a.value.shape)), (b, lambda g: _fit(g * a.value, b.value.shape))])


def scaled(a: Var, by: float | np.ndarray, plus: float | np.ndarray = 0.0) -> Var:
    """a * by + plus, of constants."""
    return Var(a.value * by + plus, [(a, lambda g: g * by)])


def matmul(a: Var, w: Var) -> Var:
    return Var(a.value @ w.value, [(a, lambda g: g @ w.value.T), (w, lambda g: a.value.T @ g)])


def typed_matmul(a: Var, w: Var, kind: np.ndarray) -> Var:
    """Row k of a times the matrix that its kind names."""
    out, rows = np.zeros((len(a.value), w.value.shape[2])), [np.flatnonzero(kind == r) for r in range(len(w.value))]
    for r, at in enumerate(rows):
        out[at] = a.value[at] @ w.value[r]

    def to_rows(g):
        got = np.zeros_like(a.value)
        for r, at in enumerate(rows):
            got[at] = g[at] @ w.value[r].T
        return got

    return Var(out, [(a, to_rows), (w, lambda g: np.stack([a.value[at].T @ g[at] for at in rows]))])


def cat(*parts: Var) -> Var:
    """Columns side by side."""
    ends = np.cumsum([0] + [p.value.shape[1] for p in parts])
    return Var(np.concatenate([p.value for p in parts], axis=1), [(p, lambda g, k=k: g[:, ends[k] : ends[k + 1]]) for k, p in enumerate(parts)])


def columns(a: Var, start: int, end: int) -> Var:
    def share(g):
        out = np.zeros_like(a.value)
        out[:, start:end] = g
        return out

    return Var(a.value[:, start:end], [(a, share)])


def _sums(rows: np.ndarray, seg: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each segment: runs of the rows in order of their segments, which are many at once."""
    out = np.zeros((n, *rows.shape[1:]))
    if not len(seg):
        return out
    if (seg[1:] < seg[:-1]).any():
        order = np.argsort(seg, kind="stable")
        rows, seg = rows[order], seg[order]
    starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
    out[seg[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def take(a: Var, at: np.ndarray) -> Var:
    return Var(a.value[at], [(a, lambda g: _sums(g, at, len(a.value)))])


def seg_sum(a: Var, seg: np.ndarray, n: int) -> Var:
    return Var(_sums(a.value, seg, n), [(a, lambda g: g[seg])])


def seg_mean(a: Var, seg: np.ndarray, n: int) -> Var:
    """Means of the rows of each segment; zero where there are none."""
    share = 1.0 / np.maximum(np.bincount(seg, minlength=n), 1)
    return scaled(seg_sum(a, seg, n), share[:, None])


def seg_softmax(a: Var, seg: np.ndarray, n: int) -> Var:
    """Of one column, within each segment."""
    most = np.full((n, 1), -np.inf)
    np.maximum.at(most, seg, a.value)
    e = np.exp(a.value - most[seg])
    p = e / _sums(e, seg, n)[seg]
    return Var(p, [(a, lambda g: p * (g - _sums(p * g, seg, n)[seg]))])


def norm(a: Var, gain: Var, shift: Var, eps: float = 1e-5) -> Var:
    """Rows brought to mean 0 and variance 1, then gain and shift."""
    off = a.value - a.value.mean(axis=1, keepdims=True)
    inv = 1.0 / np.sqrt((off * off).mean(axis=1, keepdims=True) + eps)
    unit = off * inv

    def share(g):
        g = g * gain.value
        return inv * (g - g.mean(axis=1, keepdims=True) - unit * (g * unit).mean(axis=1, keepdims=True))

    return Var(unit * gain.value + shift.value, [(a, share), (gain, lambda g: (g * unit).sum(axis=0)), (shift, lambda g: g.sum(axis=0))])


def norm_linear(a: Var, gain: Var, shift: Var, w: Var, b: Var, eps: float = 1e-5) -> Var:
    """matmul(norm(a, gain, shift), w) + b at once: with the gain in the weights, the wide rows are not written again on the way."""
    x, width = a.value, a.value.shape[1]
    scaled_w = gain.value[:, None] * w.value
    mean = x @ np.full((width, 1), 1.0 / width)
    off = x - mean
    inv = 1.0 / np.sqrt(np.einsum("ij,ij->i", off, off)[:, None] / width + eps)
    z = inv * (off @ scaled_w)  # the unit rows times the weights
    whole: dict[int, np.ndarray] = {}

    def to_scaled(g):  # of the weights with the gain in them; computed once for w and gain
        if id(g) not in whole:
            whole.clear()
            whole[id(g)] = off.T @ (inv * g)
        return whole[id(g)]

    def to_rows(g):
        got = g @ scaled_w.T
        got -= g @ (scaled_w.sum(axis=0)[:, None] / width)
        got -= off * (inv * (np.einsum("ij,ij->i", g, z)[:, None] / width))
        got *= inv
        return got

    value = z + (shift.value @ w.value + b.value)
    return Var(value, [
        (a, to_rows), (gain, lambda g: (to_scaled(g) * w.value).sum(axis=1)), (shift, lambda g: w.value @ g.sum(axis=0)),
        (w, lambda g: gain.value[:, None] * to_scaled(g) + np.outer(shift.value, g.sum(axis=0))), (b, lambda g: g.sum(axis=0)),
    ])


#: erf at the points of a grid, and its slope there
_STEP = 1.0 / 64
_GRID = np.arange(-6 * 64, 6 * 64 + 1) * _STEP
_ERF = np.array([math.erf(x) for x in _GRID])
_SLOPE = 2.0 / math.sqrt(math.pi) * np.exp(-(_GRID**2))


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, by its Taylor series at the nearest point of a grid; beyond 6 it is 1 in doubles. NaN stays NaN."""
    x = np.clip(x, -6.0, 6.0)
    at = np.rint(np.nan_to_num(x) / _STEP).astype(np.intp) + 6 * 64
    p, d = _GRID[at], x - _GRID[at]
    q = p * p
    # the derivatives of exp(-p^2) by Hermite polynomials, each over its factorial
    series = d * (4.0 * q * q - 12.0 * q + 3.0) / 30.0 - p * (2.0 * q - 3.0) / 6.0
    series += d * d * -p * (4.0 * q * q - 20.0 * q + 15.0) / 90.0
    series = (2.0 * q - 1.0) / 3.0 + d * series
    return _ERF[at] + _SLOPE[at] * d * (1.0 + d * (-p + d * series))


def gelu(a: Var) -> Var:
    below = 0.5 * (1.0 + erf(a.value / math.sqrt(2.0)))
    return Var(a.value * below, [(a, lambda g: g * (below + a.value * np.exp(-0.5 * a.value**2) / math.sqrt(2.0 * math.pi)))])


def sigmoid(a: Var) -> Var:
    p = 0.5 * (1.0 + np.tanh(0.5 * a.value))
    return Var(p, [(a, lambda g: g * p * (1.0 - p))])


def tanh(a: Var) -> Var:
    t = np.tanh(a.value)
    return Var(t, [(a, lambda g: g * (1.0 - t * t))])


def sin(a: Var) -> Var:
    return Var(np.sin(a.value), [(a, lambda g: g * np.cos(a.value))])


def absolute(a: Var) -> Var:
    return Var(np.abs(a.value), [(a, lambda g: g * np.sign(a.value))])


def softplus(a: Var) -> Var:
    """log(1 + exp(a))."""
    return Var(np.logaddexp(0.0, a.value), [(a, lambda g: g * 0.5 * (1.0 + np.tanh(0.5 * a.value)))])


def log_softmax(a: Var) -> Var:
    """Of each row."""
    off = a.value - a.value.max(axis=1, keepdims=True)
    out = off - np.log(np.exp(off).sum(axis=1, keepdims=True))
    return Var(out, [(a, lambda g: g - np.exp(out) * g.sum(axis=1, keepdims=True))])


def smooth_l1(a: Var, beta: float) -> Var:
    """Squares near zero, absolute values beyond beta."""
    size = np.abs(a.value)
    out = np.where(size < beta, 0.5 * a.value**2 / beta, size - 0.5 * beta)
    return Var(out, [(a, lambda g: g * np.clip(a.value / beta, -1.0, 1.0))])


def total(a: Var) -> Var:
    return Var(a.value.sum(), [(a, lambda g: np.broadcast_to(g, a.value.shape))])
