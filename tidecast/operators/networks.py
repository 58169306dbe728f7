"""Sequence and hemisphere networks on the differentiation of ``functions.autodiff``.

Inputs and target are standardised on the training rows.  Sequence models read
the ``sequence_length`` rows that end with the row itself; rows before the first
repeat it, and new rows follow the training rows.  Every predictor carries
``gradient(x)``: the derivative of each prediction by its own row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from ..functions.autodiff import Adam, Tensor, joined, stacked, tensor
from .kernels import MODELS, ModelSpec


def _weights(rng: np.random.Generator, *shape: int) -> Tensor:
    return Tensor(rng.normal(0, 1 / np.sqrt(shape[0]), shape))


def _standard(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = v.std(0)
    return v.mean(0), np.where(s > 1e-12, s, 1.0)


def _dropped(t: Tensor, share: float, rng: np.random.Generator | None) -> Tensor:
    return t if rng is None or share <= 0 else t * ((rng.random(t.value.shape) >= share) / (1 - share))


def sequences(x: np.ndarray, length: int, before: np.ndarray | None = None) -> np.ndarray:
    """(row, step, column): each row with the ``length - 1`` rows above it."""
    head = before[-(length - 1) :] if before is not None and length > 1 else x[:0]
    head = np.concatenate([np.repeat((head if len(head) else x)[:1], length - 1 - len(head), 0), head])
    whole = np.concatenate([head, x])
    return whole[np.arange(len(x))[:, None] + np.arange(length)[None]]


class Layers:
    """Fully connected layers with ReLU between them."""

    def __init__(self, rng: np.random.Generator, sizes: list[int], dropout: float = 0.0):
        self.w = [(_weights(rng, a, b), Tensor(np.zeros(b))) for a, b in zip(sizes, sizes[1:])]
        self.dropout = dropout

    def weights(self) -> list[Tensor]:
        return [v for pair in self.w for v in pair]

    def __call__(self, x: Tensor, last_linear: bool = True, rng: np.random.Generator | None = None) -> Tensor:
        for i, (w, b) in enumerate(self.w):
            x = x @ w + b
            if i < len(self.w) - 1 or not last_linear:
                x = _dropped(x.relu(), self.dropout, rng)
        return x


class Recurrent:
    """Stacked LSTM or GRU cells; the last state goes to one linear output."""

    def __init__(self, rng, kind: str, n_in: int, hidden: int, layers: int, dropout: float):
        gates = 4 if kind == "lstm" else 3
        self.kind, self.hidden, self.dropout = kind, hidden, dropout
        sizes = [n_in] + [hidden] * (layers - 1)
        self.cells = [(_weights(rng, a, gates * hidden), _weights(rng, hidden, gates * hidden), Tensor(np.zeros(gates * hidden))) for a in sizes]
        self.out = Layers(rng, [hidden, 1])

    def weights(self) -> list[Tensor]:
        return [v for c in self.cells for v in c] + self.out.weights()

    def states(self, x: Tensor, rng=None) -> Tensor:
        steps, n, k = [x[:, t] for t in range(x.value.shape[1])], x.value.shape[0], self.hidden
        part = lambda v, i: v[:, i * k : (i + 1) * k]
        for layer, (w, u, b) in enumerate(self.cells):
            h, c, out = tensor(np.zeros((n, k))), tensor(np.zeros((n, k))), []
            for x_t in steps:
                a, r = x_t @ w + b, h @ u
                if self.kind == "lstm":
                    v = a + r
                    c = part(v, 0).sigmoid() * c + part(v, 1).sigmoid() * part(v, 2).tanh()
                    h = part(v, 3).sigmoid() * c.tanh()
                else:
                    z, q = (part(a, 0) + part(r, 0)).sigmoid(), (part(a, 1) + part(r, 1)).sigmoid()
                    h = z * h + (1 - z) * (part(a, 2) + q * part(r, 2)).tanh()
                out.append(h)
            steps = out if layer == len(self.cells) - 1 else [_dropped(t, self.dropout, rng) for t in out]
        return stacked(steps)

    def __call__(self, x: Tensor, rng=None) -> Tensor:
        return self.out(_dropped(self.states(x, rng)[:, -1], self.dropout, rng))[:, 0]


class Encoder:
    """Transformer encoder: positions, self-attention in heads, two layers per position; the mean over steps is read out."""

    def __init__(self, rng, n_in: int, hidden: int, layers: int, length: int, dropout: float, heads: int = 2):
        self.heads, self.hidden, self.dropout = heads if hidden % heads == 0 else 1, hidden, dropout
        self.inlet = Layers(rng, [n_in, hidden])
        at = np.arange(length)[:, None] / 10000 ** (2 * (np.arange(hidden)[None] // 2) / hidden)
        self.place = np.where(np.arange(hidden) % 2, np.cos(at), np.sin(at))
        self.blocks = [([_weights(rng, hidden, hidden) for _ in range(4)], Layers(rng, [hidden, 2 * hidden, hidden], dropout)) for _ in range(layers)]
        self.out = Layers(rng, [hidden, 1])

    def weights(self) -> list[Tensor]:
        return [*self.inlet.weights(), *[v for ws, f in self.blocks for v in [*ws, *f.weights()]], *self.out.weights()]

    def states(self, x: Tensor, rng=None) -> Tensor:
        h, size = self.inlet(x) + self.place, self.hidden // self.heads
        for (q, k, v, o), feed in self.blocks:
            heads = []
            for i in range(self.heads):
                cut = (slice(None), slice(None), slice(i * size, (i + 1) * size))
                a, b, c = (h @ q)[cut], (h @ k)[cut], (h @ v)[cut]
                heads.append((a @ b.turned() * size**-0.5).softmax() @ c)
            h = (h + _dropped(joined(heads) @ o, self.dropout, rng)).normed()
            h = (h + _dropped(feed(h, rng=rng), self.dropout, rng)).normed()
        return h

    def __call__(self, x: Tensor, rng=None) -> Tensor:
        return self.out(self.states(x, rng).mean(1))[:, 0]


def train(net, inputs: np.ndarray, loss: Callable, rate: float, epochs: int, batch: int, rng, keep: Callable[[], float] | None = None, patience: int = 0) -> list[float]:
    """Adam over shuffled batches; with ``keep`` the weights of the least held-out loss stay.  Losses by epoch."""
    adam, trace, best, since = Adam(net.weights(), rate), [], (np.inf, None), 0
    for _ in range(epochs):
        order, total = rng.permutation(len(inputs)), 0.0
        for a in range(0, len(order), batch):
            ids = order[a : a + batch]
            now = loss(ids, rng)
            adam.step(now)
            total += float(now.value) * len(ids)
        trace.append(total / len(order))
        if keep is not None:
            held = keep()
            if held < best[0] - 1e-12:
                best, since = (held, [w.value.copy() for w in net.weights()]), 0
            else:
                since += 1
                if since > patience:
                    break
    if best[1] is not None:
        for w, v in zip(net.weights(), best[1]):
            w.value = v
    return trace


def _sequence_model(make: Callable, x, y, sequence_length, learning_rate, max_epochs, batch_size, random_state):
    rng = np.random.default_rng(random_state)
    (mx, sx), (my, sy) = _standard(x), _standard(y)
    z, t = sequences((x - mx) / sx, sequence_length), (y - my) / sy
    net = make(rng)
    mse = lambda ids, r: ((net(tensor(z[ids]), r) - t[ids]) ** 2.0).mean()
    trace = train(net, z, mse, learning_rate, max_epochs, batch_size, rng)
    windows = lambda new: sequences((new - mx) / sx, sequence_length, (x - mx) / sx)

    def predict(new: np.ndarray) -> np.ndarray:
        return net(tensor(windows(np.asarray(new, float)))).value * sy + my

    def gradient(new: np.ndarray) -> np.ndarray:
        held = Tensor(windows(np.asarray(new, float)))
        net(held).sum().backward()
        return held.grad[:, -1] * sy / sx

    predict.gradient, predict.trace = gradient, trace
    predict.hidden = lambda new: net.states(tensor(windows(np.asarray(new, float)))).value[:, -1]
    return predict


def lstm(x, y, sequence_length=4, hidden_size=32, num_layers=1, dropout=0.0, learning_rate=0.001, max_epochs=100, batch_size=32, random_state=0):
    make = lambda rng: Recurrent(rng, "lstm", x.shape[1], hidden_size, num_layers, dropout)
    return _sequence_model(make, x, y, sequence_length, learning_rate, max_epochs, batch_size, random_state)


def gru(x, y, sequence_length=4, hidden_size=32, num_layers=1, dropout=0.0, learning_rate=0.001, max_epochs=100, batch_size=32, random_state=0):
    make = lambda rng: Recurrent(rng, "gru", x.shape[1], hidden_size, num_layers, dropout)
    return _sequence_model(make, x, y, sequence_length, learning_rate, max_epochs, batch_size, random_state)


def transformer(x, y, sequence_length=4, hidden_size=32, num_layers=1, dropout=0.0, learning_rate=0.001, max_epochs=100, batch_size=32, random_state=0):
    make = lambda rng: Encoder(rng, x.shape[1], hidden_size, num_layers, sequence_length, dropout)
    return _sequence_model(make, x, y, sequence_length, learning_rate, max_epochs, batch_size, random_state)


class Hemispheres:
    """Shared layers, then one stack for the mean and one for the variance, whose average is set by ``nu``."""

    def __init__(self, rng, n_in: int, common: int, mean: int, variance: int, neurons: int, dropout: float, nu: float):
        self.common = Layers(rng, [n_in, *[neurons] * common], dropout)
        self.mean = Layers(rng, [*[neurons] * (mean + 1), 1], dropout)
        self.variance = Layers(rng, [*[neurons] * (variance + 1), 1], dropout)
        self.nu = nu

    def weights(self) -> list[Tensor]:
        return self.common.weights() + self.mean.weights() + self.variance.weights()

    def __call__(self, x: Tensor, rng=None) -> tuple[Tensor, Tensor]:
        h = self.common(x, False, rng)
        raw = self.variance(h, rng=rng)[:, 0].softplus() + 1e-6
        # Volatility emphasis: the variances average to nu, whatever the stack puts out.
        return self.mean(h, rng=rng)[:, 0], raw / raw.mean() * self.nu if rng is not None else raw


def _hemisphere_ensemble(x, y, net_of, nu, rate, epochs, n, subsample, patience, held_share, block, clip, rescale, seed, quantile_levels):
    """Members on subsamples by blocks of time; out-of-bag rows stop the training and rescale the variance."""
    rng = np.random.default_rng(seed)
    (mx, sx), (my, sy) = _standard(x), _standard(y)
    z, t, members = (x - mx) / sx, (y - my) / sy, []
    blocks = np.arange(len(t)) // block
    out_mean, out_var, hits = np.zeros(len(t)), np.zeros(len(t)), np.zeros(len(t))
    for _ in range(n):
        kinds = np.unique(blocks)
        taken = np.isin(blocks, rng.choice(kinds, max(1, round(subsample * len(kinds))), replace=False))
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        cut = max(1, int(len(inside) * (1 - held_share)))
        fit, held = inside[:cut], inside[cut:] if cut < len(inside) else inside
        net = net_of(rng, nu)

        def nll(ids, r, rows=fit, net=net):
            m, v = net(tensor(z[rows[ids]]), r)
            return (v.log() + (m - t[rows[ids]]) ** 2.0 / v).mean()

        def outside_loss(net=net, held=held):
            m, v = net(tensor(z[held]))
            v = v.value / v.value.mean() * nu
            return float((np.log(v) + (m.value - t[held]) ** 2 / v).mean())

        train(net, fit, nll, rate, epochs, len(fit), rng, outside_loss, patience)
        scale = nu / net(tensor(z[fit]))[1].value.mean()
        members.append((net, scale))
        if len(outside):
            m, v = net(tensor(z[outside]))
            out_mean[outside] += m.value
            out_var[outside] += v.value * scale
            hits[outside] += 1
    factor = 1.0
    seen = hits > 0
    if rescale and seen.sum() >= 5:  # reality check of the out-of-bag variance
        e = (t[seen] - out_mean[seen] / hits[seen]) ** 2
        factor = float(np.exp(np.mean(np.log(e + 1e-8)) - np.mean(np.log(out_var[seen] / hits[seen])) + 1.2704))

    def both(new):
        q = (np.asarray(new, float) - mx) / sx
        m, v = zip(*[(a.value, b.value * s) for net, s in members for a, b in [net(tensor(q))]])
        return np.mean(m, 0) * sy + my, np.maximum(np.mean(v, 0) * factor, clip**2) * sy**2

    def gradient(new):
        total = 0.0
        for net, _ in members:
            held = Tensor((np.asarray(new, float) - mx) / sx)
            net(held)[0].sum().backward()
            total = total + held.grad
        return total / len(members) * sy / sx

    def quantiles(new, levels=quantile_levels):
        from ..functions.stats import norm_ppf

        m, v = both(new)
        return m[:, None] + np.sqrt(v)[:, None] * np.array([norm_ppf(q) for q in levels])[None]

    predict = lambda new: both(new)[0]
    predict.variance, predict.quantiles, predict.gradient = (lambda new: both(new)[1]), quantiles, gradient
    return predict


def hemisphere_nn(x, y, lc=2, lm=2, lv=2, neurons=64, dropout=0.2, learning_rate=0.001, max_epochs=40, n_estimators=20, subsample=0.8, nu=None, variance_penalty=1.0, patience=8, validation_fraction=0.2, random_state=0, quantile_levels=(0.05, 0.5, 0.95)):
    """Mean and variance hemispheres; ``nu`` (share of the target's variance) defaults to half, scaled by ``variance_penalty``."""
    nu = float(nu if nu is not None else 0.5 * variance_penalty)
    make = lambda rng, v: Hemispheres(rng, x.shape[1], lc, lm, lv, neurons, dropout, v)
    return _hemisphere_ensemble(x, y, make, nu, learning_rate, max_epochs, n_estimators, subsample, patience, validation_fraction, 1, 1e-3, False, random_state, quantile_levels)


def density_hnn(x, y, common_layers=2, mean_layers=2, volatility_layers=2, prior_layers=3, neurons=400, dropout=0.2, learning_rate=0.001, max_epochs=40, n_estimators=20, prior_estimators=10, subsample=0.8, block_size=8, volatility_emphasis=None, rescale_volatility=True, patience=8, random_state=0, quantile_levels=(0.05, 0.5, 0.95), volatility_clip=0.05):
    """Hemispheres whose volatility emphasis is the out-of-bag error share of plain networks fitted first."""
    if volatility_emphasis is None:
        rng, (mx, sx), (my, sy) = np.random.default_rng(random_state + 1), _standard(x), _standard(y)
        z, t, blocks = (x - mx) / sx, (y - my) / sy, np.arange(len(y)) // block_size
        total, hits = np.zeros(len(t)), np.zeros(len(t))
        for _ in range(prior_estimators):
            kinds = np.unique(blocks)
            taken = np.isin(blocks, rng.choice(kinds, max(1, round(subsample * len(kinds))), replace=False))
            rows, net = np.flatnonzero(taken), Layers(rng, [x.shape[1], *[neurons] * (prior_layers - 1), 1], dropout)
            mse = lambda ids, r, net=net, rows=rows: ((net(tensor(z[rows[ids]]), rng=r)[:, 0] - t[rows[ids]]) ** 2.0).mean()
            train(net, rows, mse, learning_rate, max_epochs, len(rows), rng)
            total[~taken] += net(tensor(z[~taken])).value[:, 0] if (~taken).any() else 0.0
            hits[~taken] += 1
        seen = hits > 0
        volatility_emphasis = float(np.clip(((t[seen] - total[seen] / hits[seen]) ** 2).mean(), 0.01, 0.99)) if seen.any() else 0.5
    make = lambda rng, v: Hemispheres(rng, x.shape[1], common_layers, mean_layers, volatility_layers, neurons, dropout, v)
    return _hemisphere_ensemble(x, y, make, volatility_emphasis, learning_rate, max_epochs, n_estimators, subsample, patience, 0.2, block_size, volatility_clip, rescale_volatility, random_state, quantile_levels)


for _name, _fit in (("lstm", lstm), ("gru", gru), ("transformer", transformer), ("hemisphere_nn", hemisphere_nn), ("density_hnn", density_hnn)):
    MODELS[_name] = ModelSpec(_name, _fit, "supervised", "network")
