"""Forward and backward formulas on one strip of rows, used inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from kinfold.functions.vectors import EPS, L2_EPS
from kinfold.operators.blocks import Rows

STRIP = 256  # rows made dense at once
_HELD = 1 << 17  # reconstructed values taken at once, which caches hold
_FEW = 0.1  # share of the columns used that sparse rows have, up to which they are multiplied row by row


def sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1.0 / (1.0 + e), e / (1.0 + e))


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0.0) + np.log1p(np.exp(-np.abs(x)))


# Name -> (function, derivative written in the function's value).
ACT = {
    "sigmoid": (sigmoid, lambda y: y * (1.0 - y)),
    "tanh": (np.tanh, lambda y: 1.0 - y * y),
    "none": (lambda x: x, lambda y: np.ones_like(y)),
}


@dataclass
class Params:
    """W (terms x components), hidden and visible bias."""

    w: np.ndarray
    bh: np.ndarray
    bv: np.ndarray

    @property
    def n_features(self) -> int:
        return self.w.shape[0]


def _entries(rows: Rows, s: int, e: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Columns and values of rows s..e one by one, if they are few; the last value of a repeated column counts."""
    idx = rows.idx[rows.offsets[s] : rows.offsets[e]]
    if len(idx) > _FEW * (e - s) * len(np.unique(idx)):
        return None
    out = []
    for start, end in zip(rows.offsets[s:e], rows.offsets[s + 1 : e + 1]):
        cols, val = rows.idx[start:end], rows.val[start:end]
        if len(cols) > 1 and (np.diff(cols) <= 0).any():
            cols, at = np.unique(cols[::-1], return_index=True)
            val = val[::-1][at]
        out.append((cols, val))
    return out


def pre_activation(params: Params, rows: Rows, s: int, e: int):
    """``X W + bh`` for rows s..e, with the columns used and their dense values, or with the rows' entries."""
    if not rows.sparse:
        x = rows.dense[s:e]
        return x @ params.w + params.bh, None, x
    entries = _entries(rows, s, e)
    if entries is not None:
        a = np.empty((e - s, params.w.shape[1]))
        for row, (cols, val) in zip(a, entries):
            row[:] = val @ params.w[cols]
        return a + params.bh, None, entries
    cols = np.unique(rows.idx[rows.offsets[s] : rows.offsets[e]])
    x = rows.densify(s, e, cols)
    return x @ params.w[cols] + params.bh, cols, x


def encode(params: Params, rows: Rows, act: str) -> np.ndarray:
    f = ACT[act][0]
    out = np.empty((rows.n, params.w.shape[1]))
    for s in range(0, rows.n, STRIP):
        e = min(s + STRIP, rows.n)
        out[s:e] = f(pre_activation(params, rows, s, e)[0]) - f(params.bh)
    return out


def loss_and_slope(x: np.ndarray, d: np.ndarray, kind: str):
    """Row losses and their derivative by the reconstruction."""
    if kind == "cross_entropy":
        loss = -(x * np.log(d + EPS) + (1.0 - x) * np.log(1.0 - d + EPS)).sum(1)
        return loss, -(x / (d + EPS) - (1.0 - x) / (1.0 - d + EPS))
    if kind == "mean_squared":
        return ((d - x) ** 2).sum(1), 2.0 * (d - x)
    sx = (x * x).sum(1, keepdims=True)
    sd = (d * d).sum(1, keepdims=True)
    xn = x / np.sqrt(np.maximum(sx, L2_EPS))
    inv = 1.0 / np.sqrt(np.maximum(sd, L2_EPS))
    dn = d * inv
    cos = (xn * dn).sum(1, keepdims=True)
    # Below the floor the norm is a constant, so only the first term is left.
    slope = -(xn - np.where(sd > L2_EPS, cos * dn, 0.0)) * inv
    return -cos[:, 0], slope


class Gradient:
    """Sums of one task: gradients of W, bh, bv."""

    def __init__(self, params: Params):
        self.w = np.zeros_like(params.w)
        self.bh = np.zeros_like(params.bh)
        self.bv = np.zeros_like(params.bv)


def dense_input(rows: Rows, s: int, e: int, n_features: int) -> np.ndarray:
    return rows.densify(s, e, np.arange(n_features)) if rows.sparse else rows.dense[s:e]


def decode(params: Params, h: np.ndarray, act: str) -> np.ndarray:
    return ACT[act][0](h @ params.w.T + params.bv)


def _logistic_entropy(z: np.ndarray, clean: Rows, s: int, e: int, with_slope: bool = True) -> np.ndarray:
    """Cross-entropy of ``sigmoid(z)`` with rows s..e; ``z`` becomes its slope by ``z``.

    All values are first taken as zeros of the input, in place; then the
    entries of the rows are put right.
    """
    n, width = z.shape
    idx, val = clean.idx[clean.offsets[s] : clean.offsets[e]], clean.val[clean.offsets[s] : clean.offsets[e]]
    row = np.repeat(np.arange(n), np.diff(clean.offsets[s : e + 1]))
    place = row * width + idx
    if len(place) > 1 and (np.diff(place) <= 0).any():  # the last value of a repeated column counts
        _, at = np.unique(place[::-1], return_index=True)
        at = len(place) - 1 - at
        idx, val, row = idx[at], val[at], row[at]
    d = sigmoid(z[row, idx])
    rest = 1.0 - d + EPS
    loss = np.empty(n)
    step = max(1, _HELD // max(width, 1))
    with np.errstate(over="ignore"):
        for i in range(0, n, step):
            part = z[i : i + step]
            np.negative(part, out=part)
            np.exp(part, out=part)
            part += 1.0
            np.reciprocal(part, out=part)  # sigmoid
            left = 1.0 - part
            if with_slope:
                part *= left
            left += EPS
            if with_slope:
                part /= left
            loss[i : i + step] = -np.log(left, out=left).sum(1)
    log_rest = np.log(rest)
    loss += np.bincount(row, log_rest - (val * np.log(d + EPS) + (1.0 - val) * log_rest), minlength=n)
    if with_slope:
        z[row, idx] = -(val / (d + EPS) - (1.0 - val) / rest) * (d * (1.0 - d))
    return loss


def _by_entries(rows: Rows, dec: str, loss: str) -> bool:
    return rows.sparse and dec == "sigmoid" and loss == "cross_entropy"


def strip_losses(params: Params, h: np.ndarray, clean: Rows, s: int, e: int, dec: str, loss: str) -> np.ndarray:
    """Losses of rows s..e, whose codes are ``h``."""
    if _by_entries(clean, dec, loss):
        z = h @ params.w.T
        z += params.bv
        return _logistic_entropy(z, clean, s, e, with_slope=False)
    return loss_and_slope(dense_input(clean, s, e, params.n_features), decode(params, h, dec), loss)[0]


def row_losses(params: Params, clean: Rows, corrupted: Rows, enc: str, dec: str, loss: str) -> np.ndarray:
    out = np.empty(clean.n)
    f = ACT[enc][0]
    for s in range(0, clean.n, STRIP):
        e = min(s + STRIP, clean.n)
        h = f(pre_activation(params, corrupted, s, e)[0]) - f(params.bh)
        out[s:e] = strip_losses(params, h, clean, s, e, dec, loss)
    return out


def reconstruct(
    params: Params,
    grad: Gradient,
    clean: Rows,
    corrupted: Rows,
    s: int,
    e: int,
    weight: np.ndarray,
    slope_h: np.ndarray | None,
    enc: str,
    dec: str,
    loss: str,
) -> np.ndarray:
    """Add the gradient of rows s..e; return their row losses.

    ``weight`` scales each row's reconstruction loss; ``slope_h`` is the
    derivative by the code from elsewhere (triplets).
    """
    f, df = ACT[enc]
    g, dg = ACT[dec]
    a, cols, x_in = pre_activation(params, corrupted, s, e)
    fa, fb = f(a), f(params.bh)
    h = fa - fb
    z = h @ params.w.T
    z += params.bv
    if _by_entries(clean, dec, loss):
        loss_rows, dz = _logistic_entropy(z, clean, s, e), z
        dz *= weight[:, None]
    else:
        d = g(z)
        x = dense_input(clean, s, e, params.n_features)
        loss_rows, slope = loss_and_slope(x, d, loss)
        dz = slope * weight[:, None] * dg(d)
    dh = dz @ params.w
    if slope_h is not None:
        dh = dh + slope_h
    da = dh * df(fa)
    if isinstance(x_in, list):
        for (at, val), row in zip(x_in, da):
            grad.w[at] += val[:, None] * row
    elif cols is None:
        grad.w += x_in.T @ da
    else:
        grad.w[cols] += x_in.T @ da
    grad.w += dz.T @ h
    grad.bv += dz.sum(0)
    grad.bh += da.sum(0) - df(fb) * dh.sum(0)
    return loss_rows


class Updater:
    """Parameter updates on summed gradients; slots can be stored and resumed."""

    ADAGRAD_START = 0.1  # fixed values: start of the accumulator, moment decay rates, denominator guard
    BETA1, BETA2, ADAM_EPS = 0.9, 0.999, 1e-8

    def __init__(self, opt: str, learning_rate: float, momentum: float):
        self.opt, self.rate, self.momentum = opt, learning_rate, momentum
        self.slots: dict[str, dict[str, np.ndarray]] = {}
        self.steps = 0

    def slot_names(self) -> tuple[str, ...]:
        return {"momentum": ("velocity",), "ada_grad": ("squares",), "adam": ("mean", "square")}.get(self.opt, ())

    def start(self, params: Params) -> None:
        for name in self.slot_names():
            if name not in self.slots:
                first = self.ADAGRAD_START if name == "squares" else 0.0
                self.slots[name] = {k: np.full_like(getattr(params, k), first) for k in ("w", "bh", "bv")}

    def apply(self, params: Params, grad: Gradient) -> Params:
        self.start(params)
        self.steps += 1
        out = {}
        for k in ("w", "bh", "bv"):
            p, g = getattr(params, k), getattr(grad, k)
            if self.opt == "gradient_descent":
                step = g
            elif self.opt == "momentum":
                v = self.slots["velocity"][k] = self.momentum * self.slots["velocity"][k] + g
                step = v
            elif self.opt == "ada_grad":
                acc = self.slots["squares"][k] = self.slots["squares"][k] + g * g
                step = g / np.sqrt(acc)
            else:
                m = self.slots["mean"][k] = self.BETA1 * self.slots["mean"][k] + (1 - self.BETA1) * g
                v = self.slots["square"][k] = self.BETA2 * self.slots["square"][k] + (1 - self.BETA2) * g * g
                fix = np.sqrt(1 - self.BETA2**self.steps) / (1 - self.BETA1**self.steps)
                step = fix * m / (np.sqrt(v) + self.ADAM_EPS)
            out[k] = p - self.rate * step
        return Params(**out)
