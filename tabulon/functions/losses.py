"""Losses and their gradients per element; means and sums are aggregates over them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulon.functions.guards import above, fmax
from tabulon.functions.scalar import clamp, sigmoid, sign, softplus

L = F.lit

#: name -> expression of (prediction, target); probabilities where the name says so.
LOSSES = {
    "mse": lambda p, y: (p - y) * (p - y),
    "mse_grad": lambda p, y: p - y,
    "mae": lambda p, y: F.abs(p - y),
    "mae_grad": lambda p, y: sign(p - y),
    "smooth_l1": lambda p, y: F.when(F.abs(p - y) < 0.5, 0.5 * (p - y) * (p - y) / 0.5).otherwise(F.abs(p - y) - 0.25),
    "huber": lambda p, y: F.when(F.abs(p - y) <= 1.0, 0.5 * (p - y) * (p - y)).otherwise(F.abs(p - y) - 0.5),
    "huber_grad": lambda p, y: clamp(p - y, -1.0, 1.0),
    "log_cosh": lambda p, y: F.abs(p - y) + F.log1p(F.exp(-2.0 * F.abs(p - y))) - math.log(2.0),
    "bce_with_logits": lambda z, y: F.greatest(z, L(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))),
    "bce_logits_grad": lambda z, y: sigmoid(z) - y,
    "poisson_nll": lambda z, y: F.exp(z) - y * z,
    "quantile": lambda p, y: F.greatest(0.9 * (y - p), -0.1 * (y - p)),
    "hinge": lambda s, y: F.greatest(L(0.0), 1.0 - (2.0 * y - 1.0) * s),
    "hinge_grad": lambda s, y: F.when((2.0 * y - 1.0) * s < 1.0, -(2.0 * y - 1.0)).otherwise(0.0),
    "gaussian_logprob": lambda x, m: -0.5 * (x - m) * (x - m) - 0.5 * math.log(2 * math.pi),
    "vae_kl": lambda m, lv: 0.5 * (m * m + F.exp(lv) - lv - 1.0),
}


def bce(p, y, eps: float = 1e-12):
    q = clamp(p, eps, 1.0 - eps)
    return -(y * F.ln(q) + (1.0 - y) * F.ln(1.0 - q))


def bce_grad(p, y, eps: float = 1e-7):
    q = clamp(p, eps, 1.0 - eps)
    return (q - y) / (q * (1.0 - q))


def focal(p, y, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-12):
    q = clamp(p, eps, 1.0 - eps)
    pt = F.when(y >= 0.5, q).otherwise(1.0 - q)
    a = F.when(y >= 0.5, L(alpha)).otherwise(L(1.0 - alpha))
    return -a * F.pow(1.0 - pt, L(gamma)) * F.ln(pt)


def focal_grad(p, y, gamma: float = 2.0, alpha: float = 0.25, eps: float = 1e-12):
    """Derivative of -alpha (1 - q)^gamma ln q for q = p (y over 0.5) or 1 - p."""
    p = clamp(p, eps, 1.0 - eps)
    side = F.when(above(y, 0.5), 1.0).otherwise(-1.0)
    q = F.when(above(y, 0.5), p).otherwise(1.0 - p)
    return alpha * side * (gamma * F.pow(1.0 - q, L(gamma - 1.0)) * F.ln(q) - F.pow(1.0 - q, L(gamma)) / q)


def mean_grad(grad, n: int):
    """A gradient of the mean: divided by the number of rows."""
    return grad / float(max(n, 1))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), L(0.0), lambda s, x: s + x)


def _squares(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), L(0.0), lambda s, x: s + x)


def cosine_embedding(a, b, label, margin: float = 0.0):
    """1 - cos for a positive label, else what cos has over the margin; a and b are arrays."""
    cos = _dot(a, b) / (F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)) + 1e-12)
    return F.when(above(label, 0), 1.0 - cos).otherwise(fmax(cos - margin, L(0.0)))


def triplet(anchor, near, far, margin: float = 1.0):
    """What the squared distance to the near one, plus the margin, has over that to the far one."""
    return fmax(_squares(anchor, near) - _squares(anchor, far) + margin, L(0.0))


def contrastive(a, b, label, margin: float = 1.0):
    """label * d^2 + (1 - label) * max(0, margin - d)^2."""
    d2 = _squares(a, b)
    short = fmax(margin - F.sqrt(d2), L(0.0))
    return label * d2 + (1.0 - label) * short * short


def categorical_logprob(logits, action):
    """Log-softmax of an array of logits at an action."""
    from tabulon.operators.neural import cross_entropy

    return -cross_entropy(logits, action)


def reparameterize(mean, log_var, eps):
    return mean + F.exp(0.5 * log_var) * eps


def vae_latent_grads(grad, mean, log_var, eps, weight: float):
    """(gradient of the mean, gradient of the log variance) of the reparameterised sample plus weight times the divergence from N(0, 1)."""
    return grad + weight * mean, 0.5 * (grad * F.exp(0.5 * log_var) * eps + weight * (F.exp(log_var) - 1.0))


def kl_div(logp, t):
    return F.when(t > 0, t * (F.ln(t) - logp)).otherwise(0.0)


def tweedie(mu, y, power: float = 1.5):
    return -y * F.pow(mu, L(1 - power)) / (1 - power) + F.pow(mu, L(2 - power)) / (2 - power)


PROBABILITY_LOSSES = {"bce": bce, "bce_grad": bce_grad, "focal": focal, "focal_grad": focal_grad, "kl_div": lambda p, y: kl_div(F.ln(p), y), "tweedie": tweedie, "logloss_hess": lambda p, y: clamp(p * (1.0 - p), 1e-3, 1e6), "logloss_grad": lambda p, y: p - y}

__all__ = ["LOSSES", "PROBABILITY_LOSSES", "softplus"]
