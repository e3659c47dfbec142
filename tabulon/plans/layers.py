"""Layers and optimiser steps in numpy, for use inside Arrow batches. Shapes: (rows, features), sequences (steps, features)."""

from __future__ import annotations

import numpy as np

ACTIVATIONS = {
    "linear": (lambda x: x, lambda x, y: np.ones_like(x)),
    "relu": (lambda x: np.maximum(x, 0), lambda x, y: (x > 0).astype(float)),
    "leaky": (lambda x: np.where(x > 0, x, 0.01 * x), lambda x, y: np.where(x > 0, 1.0, 0.01)),
    "sigmoid": (lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60))), lambda x, y: y * (1 - y)),
    "tanh": (np.tanh, lambda x, y: 1 - y * y),
}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def loss_grad(kind: str, out: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Summed loss and its gradient by the network's output; ce takes logits and one-hot targets, bce probabilities."""
    d = out - y
    if kind == "mse":
        return float((d * d).sum()), 2 * d
    if kind == "mae":
        return float(np.abs(d).sum()), np.sign(d)
    if kind == "huber":
        return float(np.where(np.abs(d) <= 1, 0.5 * d * d, np.abs(d) - 0.5).sum()), np.clip(d, -1, 1)
    if kind == "ce":
        p = softmax(out)
        return float(-(y * np.log(p + 1e-12)).sum()), p - y
    p = np.clip(out, 1e-7, 1 - 1e-7)
    if kind == "bce":
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), (p - y) / (p * (1 - p))
    if kind == "focal":
        g, a = 2.0, np.where(y >= 0.5, 0.25, 0.75)
        pt, s = np.where(y >= 0.5, p, 1 - p), np.where(y >= 0.5, 1.0, -1.0)
        return float((-a * (1 - pt) ** g * np.log(pt)).sum()), s * a * (g * (1 - pt) ** (g - 1) * np.log(pt) - (1 - pt) ** g / pt)
    raise ValueError(f"unknown loss {kind}")


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, places, k): all runs of k neighbouring features."""
    return np.lib.stride_tricks.sliding_window_view(x, k, axis=1)


def _affine(p: dict, x: np.ndarray) -> np.ndarray:
    """A dense layer, or a convolution along the features (w: kernel x filters), whose outputs are place after place."""
    if p.get("kind") != "conv":
        return x @ p["w"] + p["b"]
    return (_windows(x, len(p["w"])) @ p["w"] + p["b"]).reshape(len(x), -1)


def forward(params: list[dict], x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(pre-activation, output) of each layer, after the input."""
    trace = [(x, x)]
    for p in params:
        z = _affine(p, trace[-1][1])
        trace.append((z, ACTIVATIONS[p["act"]][0](z)))
    return trace


def backward(params: list[dict], trace, grad: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Gradients (dW, db) of each layer, summed over rows."""
    out = []
    for k in range(len(params) - 1, -1, -1):
        p, x = params[k], trace[k][1]
        z, y = trace[k + 1]
        grad = grad * ACTIVATIONS[p["act"]][1](z, y)
        if p.get("kind") == "conv":
            width = len(p["w"])
            g = grad.reshape(len(x), -1, p["w"].shape[1])
            out.append((np.einsum("npk,npf->kf", _windows(x, width), g), g.sum(axis=(0, 1))))
            grad = np.zeros_like(x)
            for j in range(width):
                grad[:, j : j + g.shape[1]] += g @ p["w"][j]
        else:
            out.append((x.T @ grad, grad.sum(axis=0)))
            grad = grad @ p["w"].T
    return out[::-1]


class AttentionCache:
    """Keys and values of the steps so far; a new step attends to all of them without computing them again."""

    def __init__(self):
        self.keys, self.values = [], []

    def step(self, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        self.keys.append(k)
        self.values.append(v)
        scores = np.array(self.keys) @ q / np.sqrt(len(q))
        return softmax(scores) @ np.array(self.values)


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, causal: bool = False) -> np.ndarray:
    s = q @ k.T / np.sqrt(q.shape[-1])
    if causal:
        s = np.where(np.tril(np.ones_like(s)) > 0, s, -np.inf)
    return softmax(s) @ v


def multi_head(q, k, v, heads: int, kv_heads: int | None = None, causal: bool = False) -> np.ndarray:
    """Heads side by side; with fewer key-value heads, groups of query heads share one."""
    kv, d = kv_heads or heads, q.shape[1] // heads
    parts = [attention(q[:, h * d : (h + 1) * d], *(x[:, (h * kv // heads) * d : (h * kv // heads + 1) * d] for x in (k, v)), causal) for h in range(heads)]
    return np.concatenate(parts, axis=1)


def rope(x: np.ndarray, base: float = 10_000.0) -> np.ndarray:
    """Rotary embedding, first half against second half."""
    half = x.shape[1] // 2
    angle = np.arange(len(x))[:, None] / base ** (np.arange(half) / half)
    a, b = x[:, :half], x[:, half:]
    return np.concatenate([a * np.cos(angle) - b * np.sin(angle), a * np.sin(angle) + b * np.cos(angle)], axis=1)


def lstm_cell(x, h, c, w, u, b):
    """One step; gate order input, forget, cell, output."""
    i, f, g, o = np.split(x @ w + h @ u + b, 4, axis=-1)
    s = ACTIVATIONS["sigmoid"][0]
    c = s(f) * c + s(i) * np.tanh(g)
    return s(o) * np.tanh(c), c


def gru_cell(x, h, w, u, b):
    """One step; gate order reset, update, candidate."""
    s = ACTIVATIONS["sigmoid"][0]
    (xr, xz, xn), (hr, hz, hn) = np.split(x @ w + b, 3, axis=-1), np.split(h @ u, 3, axis=-1)
    r, z = s(xr + hr), s(xz + hz)
    return (1 - z) * np.tanh(xn + r * hn) + z * h


def conv2d(x: np.ndarray, w: np.ndarray, stride: int = 1, pad: int = 0, dilation: int = 1) -> np.ndarray:
    """Cross-correlation: x (channels, h, w), w (out, channels, kh, kw)."""
    x = np.pad(x, ((0, 0), (pad, pad), (pad, pad)))
    kh, kw = (w.shape[2] - 1) * dilation + 1, (w.shape[3] - 1) * dilation + 1
    view = np.lib.stride_tricks.sliding_window_view(x, (kh, kw), axis=(1, 2))[:, ::stride, ::stride, ::dilation, ::dilation]
    return np.einsum("chwij,ocij->ohw", view, w)


def im2col(x: np.ndarray, k: int, stride: int = 1) -> np.ndarray:
    view = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(1, 2))[:, ::stride, ::stride]
    return view.transpose(1, 2, 0, 3, 4).reshape(-1, x.shape[0] * k * k)


def pool2d(x: np.ndarray, k: int, how: str = "max") -> np.ndarray:
    c, h, w = x.shape
    t = x[:, : h // k * k, : w // k * k].reshape(c, h // k, k, w // k, k)
    return t.max(axis=(2, 4)) if how == "max" else t.mean(axis=(2, 4))


def layernorm_backward(grad: np.ndarray, x: np.ndarray, gamma: np.ndarray, eps: float = 1e-5):
    mu, var = x.mean(1, keepdims=True), x.var(1, keepdims=True)
    n = (x - mu) / np.sqrt(var + eps)
    g = grad * gamma
    dx = (g - g.mean(1, keepdims=True) - n * (g * n).mean(1, keepdims=True)) / np.sqrt(var + eps)
    return dx, (grad * n).sum(0), grad.sum(0)


def moe(x: np.ndarray, gate: np.ndarray, experts: list[np.ndarray]) -> np.ndarray:
    """Dense mixture: every expert's output weighted by the softmax of the gate."""
    g = softmax(x @ gate)
    return sum(g[:, [k]] * (x @ w) for k, w in enumerate(experts))


def step(kind: str, w: np.ndarray, g: np.ndarray, s: dict, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, decay: float = 0.0) -> np.ndarray:
    """One optimiser update; s holds the state of this parameter."""
    t = s["t"] = s.get("t", 0) + 1
    get = lambda k: s.setdefault(k, np.zeros_like(w))
    if kind == "sgd":
        return w - lr * g
    if kind in ("momentum", "nesterov"):
        s["m"] = b1 * get("m") + g
        return w - lr * (s["m"] if kind == "momentum" else g + b1 * s["m"])
    if kind == "adagrad":
        s["v"] = get("v") + g * g
        return w - lr * g / (np.sqrt(s["v"]) + eps)
    if kind == "rmsprop":
        s["v"] = 0.9 * get("v") + 0.1 * g * g
        return w - lr * g / (np.sqrt(s["v"]) + eps)
    if kind == "adadelta":
        s["v"] = 0.9 * get("v") + 0.1 * g * g
        d = np.sqrt(get("d") + 1e-6) / np.sqrt(s["v"] + 1e-6) * g
        s["d"] = 0.9 * s["d"] + 0.1 * d * d
        return w - lr * d
    if kind == "lion":
        u = np.sign(b1 * get("m") + (1 - b1) * g)
        s["m"] = b2 * s["m"] + (1 - b2) * g
        return w - lr * (u + decay * w)
    if kind == "lars":
        ratio = np.linalg.norm(w) / (np.linalg.norm(g) + decay * np.linalg.norm(w) + eps)
        s["m"] = b1 * get("m") + lr * (ratio if ratio > 0 else 1.0) * (g + decay * w)
        return w - s["m"]
    s["m"], s["v"] = b1 * get("m") + (1 - b1) * g, b2 * get("v") + (1 - b2) * g * g
    m, v = s["m"] / (1 - b1**t), s["v"] / (1 - b2**t)
    if kind == "nadam":
        m = b1 * m + (1 - b1) * g / (1 - b1**t)
    if kind == "radam":
        top = 2 / (1 - b2) - 1
        rho = top - 2 * t * b2**t / (1 - b2**t)
        if rho <= 4:
            return w - lr * m
        return w - lr * np.sqrt((rho - 4) * (rho - 2) * top / ((top - 4) * (top - 2) * rho)) * m / (np.sqrt(v) + eps)
    u = m / (np.sqrt(v) + eps)
    if kind == "adamw":
        u = u + decay * w
    if kind == "lamb":
        u = u + decay * w
        a, b = np.linalg.norm(w), np.linalg.norm(u)
        u = u * (a / b if a > 0 and b > 0 else 1.0)
    elif kind not in ("adam", "adamw", "nadam"):
        raise ValueError(f"unknown optimiser {kind}")
    return w - lr * u
