"""Reverse-mode differentiation of NumPy expressions, as small as the networks need.

``Tensor`` records what it was made of; ``backward`` walks the record once and
adds up gradients.  Operations broadcast as NumPy does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _shaped(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """``g`` summed over the axes that broadcasting added."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(i, keepdims=True)
    return g


class Tensor:
    __array_priority__ = 100  # NumPy leaves ``array @ tensor`` to us

    def __init__(self, value, parents: Sequence[tuple[Tensor, Callable[[np.ndarray], np.ndarray]]] = ()):
        self.value = np.asarray(value, float)
        self.parents = tuple(parents)
        self.grad: np.ndarray | None = None

    def backward(self) -> None:
        order, seen, todo = [], set(), [(self, False)]
        while todo:  # parents before children, without recursion
            t, done = todo.pop()
            if done:
                order.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                todo.append((t, True))
                todo += [(p, False) for p, _ in t.parents]
        for t in order:
            t.grad = np.zeros_like(t.value)
        self.grad = np.ones_like(self.value)
        for t in reversed(order):
            for p, back in t.parents:
                p.grad += _shaped(back(t.grad), p.value.shape)

    def __add__(self, o):
        o = tensor(o)
        return Tensor(self.value + o.value, [(self, lambda g: g), (o, lambda g: g)])

    def __mul__(self, o):
        o = tensor(o)
        return Tensor(self.value * o.value, [(self, lambda g: g * o.value), (o, lambda g: g * self.value)])

    def __pow__(self, k: float):
        return Tensor(self.value**k, [(self, lambda g: g * k * self.value ** (k - 1))])

    def __matmul__(self, o):
        o = tensor(o)
        turn = lambda a: np.swapaxes(a, -1, -2)
        return Tensor(self.value @ o.value, [(self, lambda g: g @ turn(o.value)), (o, lambda g: turn(self.value) @ g)])

    def __rmatmul__(self, o):
        return tensor(o) @ self

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return out

        return Tensor(self.value[at], [(self, back)])

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -tensor(o)

    def __rsub__(self, o):
        return tensor(o) + -self

    def __truediv__(self, o):
        return self * tensor(o) ** -1.0

    __radd__, __rmul__ = __add__, __mul__

    def map(self, value: np.ndarray, slope: np.ndarray) -> Tensor:
        return Tensor(value, [(self, lambda g: g * slope)])

    def tanh(self):
        v = np.tanh(self.value)
        return self.map(v, 1 - v * v)

    def sigmoid(self):
        v = 1 / (1 + np.exp(-np.clip(self.value, -60, 60)))
        return self.map(v, v * (1 - v))

    def relu(self):
        return self.map(np.maximum(self.value, 0), (self.value > 0).astype(float))

    def softplus(self):
        return self.map(np.logaddexp(0, self.value), 1 / (1 + np.exp(-np.clip(self.value, -60, 60))))

    def exp(self):
        v = np.exp(np.clip(self.value, -60, 60))
        return self.map(v, v)

    def log(self):
        return self.map(np.log(self.value), 1 / self.value)

    def sum(self, axis=None, keepdims=False):
        def back(g):
            return np.broadcast_to(g if axis is None or keepdims else np.expand_dims(g, axis), self.value.shape)

        return Tensor(self.value.sum(axis=axis, keepdims=keepdims), [(self, back)])

    def mean(self, axis=None, keepdims=False):
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis, keepdims) * (1.0 / n)

    def turned(self):
        """Last two axes swapped."""
        return Tensor(np.swapaxes(self.value, -1, -2), [(self, lambda g: np.swapaxes(g, -1, -2))])

    def softmax(self):
        e = (self - self.value.max(-1, keepdims=True)).exp()
        return e / e.sum(-1, keepdims=True)

    def normed(self, eps: float = 1e-5):
        """Mean zero and variance one along the last axis."""
        c = self - self.mean(-1, keepdims=True)
        return c * ((c * c).mean(-1, keepdims=True) + eps) ** -0.5


def tensor(x) -> Tensor:
    return x if isinstance(x, Tensor) else Tensor(x)


def joined(parts: Sequence[Tensor], axis: int = -1) -> Tensor:
    cuts = np.cumsum([0, *[p.value.shape[axis] for p in parts]])
    take = lambda a, b: lambda g: np.take(g, range(a, b), axis)
    return Tensor(np.concatenate([p.value for p in parts], axis), [(p, take(a, b)) for p, a, b in zip(parts, cuts, cuts[1:])])


def stacked(parts: Sequence[Tensor], axis: int = 1) -> Tensor:
    return Tensor(np.stack([p.value for p in parts], axis), [(p, lambda g, i=i: np.take(g, i, axis)) for i, p in enumerate(parts)])


class Adam:
    def __init__(self, weights: Sequence[Tensor], rate: float, l2: float = 0.0):
        self.weights, self.rate, self.l2, self.t = list(weights), rate, l2, 0
        self.first, self.second = ([np.zeros_like(w.value) for w in self.weights] for _ in range(2))

    def step(self, loss: Tensor) -> None:
        loss.backward()
        self.t += 1
        for w, m, v in zip(self.weights, self.first, self.second):
            g = (w.grad if w.grad is not None else 0.0) + self.l2 * w.value
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w.value -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
