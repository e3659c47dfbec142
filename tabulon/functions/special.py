"""Special functions that Spark lacks, over whole Arrow batches in numpy."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: Elements whose Fourier sums are made at once.
_BLOCK = 4096


def _split(x: np.ndarray, low: np.ndarray, inside, outside) -> np.ndarray:
    """inside(x) where low holds, outside(x) elsewhere."""
    out = np.empty_like(x)
    out[low], out[~low] = inside(x[low]), outside(x[~low])
    return out


def _erf_small(x: np.ndarray) -> np.ndarray:
    """Confluent series: 2 x / sqrt(pi) * exp(-x^2) * sum of (2 x^2)^n / (1 * 3 * 5 ...)."""
    term = total = np.ones_like(x)
    for n in range(1, 80):
        term = term * 2 * x * x / (2 * n + 1)
        total = total + term
    return 2 / math.sqrt(math.pi) * x * np.exp(-x * x) * total


def _erfcx_large(x: np.ndarray) -> np.ndarray:
    """exp(x^2) erfc(x) for x of 2 or more, as a continued fraction from its tail."""
    f = x
    for k in range(120, 0, -1):
        f = x + k / 2 / f
    return 1 / (math.sqrt(math.pi) * f)


def erfc(x: np.ndarray) -> np.ndarray:
    tail = _split(np.abs(x), np.abs(x) < 2, lambda v: 1 - _erf_small(v), lambda v: _erfcx_large(v) * np.exp(-v * v))
    return np.where(x < 0, 2 - tail, tail)


def erf(x: np.ndarray) -> np.ndarray:
    return _split(x, np.abs(x) < 2, _erf_small, lambda v: np.sign(v) * (1 - erfc(np.abs(v))))


def erfcx(x: np.ndarray) -> np.ndarray:
    return _split(x, x < 2, lambda v: np.exp(v * v) * erfc(v), _erfcx_large)


def ndtr(x: np.ndarray) -> np.ndarray:
    return 0.5 * erfc(-x / math.sqrt(2))


def ndtri(p: np.ndarray) -> np.ndarray:
    """Inverse of ndtr, by bisection of the smaller tail, 64 halvings for all elements at once."""
    tail = np.minimum(p, 1 - p)
    low, high = np.full_like(p, -40.0), np.zeros_like(p)
    for _ in range(64):
        mid = (low + high) / 2
        under = ndtr(mid) < tail
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    out = np.where(p < 0.5, low, -low)
    return np.where((p < 0) | (p > 1), np.nan, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.where(p == 0.5, 0.0, out))))


#: Lanczos coefficients for g = 7.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def _lgamma_right(x: np.ndarray) -> np.ndarray:
    """ln gamma for x of 0.5 or more."""
    s = _LANCZOS[0] + sum(c / (x - 1 + k) for k, c in enumerate(_LANCZOS[1:], 1))
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * np.log(t) - t + np.log(s)


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln |gamma(x)|, by reflection on the left; infinite at the poles."""
    return _split(x, x >= 0.5, _lgamma_right, lambda v: np.where(v == np.floor(v), np.inf, math.log(math.pi) - np.log(np.abs(np.sin(math.pi * v))) - _lgamma_right(1 - v)))


def gamma(x: np.ndarray) -> np.ndarray:
    """Undefined at the poles."""
    left = lambda v: np.where(v == np.floor(v), np.nan, math.pi / (np.sin(math.pi * v) * np.exp(_lgamma_right(1 - v))))
    return _split(x, x >= 0.5, lambda v: np.exp(_lgamma_right(v)), left)


#: Even Bernoulli numbers from the second on.
_BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def _digamma_right(x: np.ndarray) -> np.ndarray:
    """Twelve steps to the right by psi(x) = psi(x + 1) - 1 / x, then the expansion at infinity in Bernoulli numbers."""
    far = x + 12
    series = sum(b / (2 * n * far ** (2 * n)) for n, b in enumerate(_BERNOULLI, 1))
    return np.log(far) - 1 / (2 * far) - series - sum(1 / (x + k) for k in range(12))


def digamma(x: np.ndarray) -> np.ndarray:
    """By reflection on the left; undefined at the poles."""
    return _split(x, x > 0, _digamma_right, lambda v: np.where(v == np.floor(v), np.nan, _digamma_right(1 - v) - math.pi / np.tan(math.pi * v)))


def _coefficients(x: np.ndarray, wave, orders: int) -> np.ndarray:
    """Fourier coefficients 0 ... orders - 1 of wave(x, t) over a period; a sum over equal steps is exact to rounding once the steps outnumber |x|."""
    steps = 1 << max(7, math.ceil(math.log2(2 * float(np.abs(x).max(initial=0)) + 2 * orders + 64)))
    t = 2 * math.pi * np.arange(steps) / steps
    return np.fft.fft(wave(x[:, None], t), axis=1)[:, :orders] / steps


def _by_blocks(x: np.ndarray, fn) -> np.ndarray:
    """fn over blocks of like magnitude, so that a large element costs its own block only."""
    out, order = np.empty_like(x), np.argsort(np.abs(x))
    for at in range(0, len(x), _BLOCK):
        part = order[at : at + _BLOCK]
        out[part] = fn(x[part])
    return out


def _bessel_j(x: np.ndarray, orders: int) -> np.ndarray:
    return _coefficients(x, lambda v, t: np.exp(1j * v * np.sin(t)), orders).real


def _j(order: int):
    return lambda x: _by_blocks(x, lambda v: _bessel_j(v, order + 1)[:, order])


def _ie(order: int):
    """exp(-|x|) I(x)."""
    return lambda x: _by_blocks(x, lambda v: _coefficients(v, lambda u, t: np.exp(u * np.cos(t) - np.abs(u)), order + 1).real[:, order])


def _y_near(order: int, x: np.ndarray) -> np.ndarray:
    """Neumann's expansion of the second kind in functions of the first kind; order 1 is its negative derivative."""
    terms = 8 + int(float(x.max(initial=1.0)))
    j = _bessel_j(x, 2 * terms + 2)
    k = np.arange(1, terms)
    log = 2 / math.pi * (np.log(x / 2) + np.euler_gamma)
    if order == 0:
        return log * j[:, 0] - 4 / math.pi * (j[:, 2 * k] * ((-1.0) ** k / k)).sum(axis=1)
    slopes = (j[:, 2 * k - 1] - j[:, 2 * k + 1]) / 2
    return log * j[:, 1] - 2 / (math.pi * x) * j[:, 0] + 4 / math.pi * (slopes * ((-1.0) ** k / k)).sum(axis=1)


def _y_far(order: int, x: np.ndarray) -> np.ndarray:
    """Hankel's expansion for large x."""
    p, q, term = np.ones_like(x), np.zeros_like(x), np.ones_like(x)
    for k in range(1, 16):
        term = term * (4 * order * order - (2 * k - 1) ** 2) / (8 * k * x)
        if k % 2:
            q = q + (-1.0) ** (k // 2) * term
        else:
            p = p + (-1.0) ** (k // 2) * term
    phase = x - (order / 2 + 0.25) * math.pi
    return np.sqrt(2 / (math.pi * x)) * (p * np.sin(phase) + q * np.cos(phase))


def _y(order: int):
    right = lambda v: _by_blocks(v, lambda u: _split(u, u < 30, lambda w: _y_near(order, w), lambda w: _y_far(order, w)))
    return lambda x: _split(x, x > 0, right, lambda v: np.where(v == 0, -np.inf, np.nan))


FUNCTIONS = {
    "erf": erf,
    "erfc": erfc,
    "erfcx": erfcx,
    "erfinv": lambda x: ndtri((x + 1) / 2) / math.sqrt(2),
    "ndtr": ndtr,
    "ndtri": ndtri,
    "gamma": gamma,
    "lgamma": lgamma,
    "digamma": digamma,
    "gelu_exact": lambda x: x * ndtr(x),
    "i0": lambda x: _ie(0)(x) * np.exp(np.abs(x)),
    "i1": lambda x: _ie(1)(x) * np.exp(np.abs(x)),
    "i0e": _ie(0),
    "i1e": _ie(1),
    "j0": _j(0),
    "j1": _j(1),
    "y0": _y(0),
    "y1": _y(1),
}
NAMES = tuple(FUNCTIONS)


def special(name: str, x: Column) -> Column:
    fn = FUNCTIONS[name]

    @arrow_udf("double")
    def run(v: pa.Array) -> pa.Array:
        a = v.to_numpy(zero_copy_only=False).astype(float)
        ok = ~np.isnan(a)
        out = np.full(len(a), np.nan)
        with np.errstate(all="ignore"):
            if ok.any():
                out[ok] = fn(a[ok])
        return pa.array(out, mask=v.is_null().to_numpy(zero_copy_only=False))

    return run(x.cast("double"))
