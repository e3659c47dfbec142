"""Elementwise functions of one or two doubles, as Column expressions that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.guards import above, ceil, floor, floormod, fmax, fmin, fmod, ieee_div, ieee_ln, ieee_log1p, ieee_log2, ieee_log10, signbit, trunc

L = F.lit
#: Constants of the activation functions.
SELU_ALPHA, SELU_SCALE = 1.6732632423543772, 1.0507009873554805


def sign(x):
    return F.when(above(x, 0), 1.0).when(x < 0, -1.0).otherwise(0.0)


def sigmoid(x):
    return 1.0 / (1.0 + F.exp(-x))


def clamp(x, lo, hi):
    return fmin(fmax(x, L(lo)), L(hi))


def logaddexp(x, y):
    return fmax(x, y) + F.log1p(F.exp(-F.abs(x - y)))


def logaddexp2(x, y):
    return fmax(x, y) + F.log2(1.0 + F.pow(L(2.0), -F.abs(x - y)))


def heaviside(x, at_zero):
    return F.when(x < 0, 0.0).when(above(x, 0), 1.0).otherwise(at_zero)


def xlogy(x, y):
    return F.when(x == 0, 0.0).otherwise(x * ieee_ln(y))


def xlog1py(x, y):
    return F.when(x == 0, 0.0).otherwise(x * ieee_log1p(y))


def entr(x):
    return F.when(above(x, 0), -x * F.ln(x)).when(x == 0, 0.0).otherwise(-math.inf)


def sinc(x):
    return F.when(x == 0, 1.0).otherwise(F.sin(math.pi * x) / (math.pi * x))


def copysign(x, y):
    return F.when(signbit(y), -F.abs(x)).otherwise(F.abs(x))


def power(x, y):
    return F.when((x == 1) | (y == 0), 1.0).otherwise(F.pow(x, y))


def logit(x):
    return ieee_ln(ieee_div(x, 1.0 - x))


def next_after(x, y):
    """The double next to x towards y; its last place is a power of two that follows from x."""
    tiny = float.fromhex("0x1p-1074")
    size = F.abs(x)
    # The exponent by logarithm, mended where the rounding of the logarithm went over a power of two.
    e = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0)))
    e = F.when(F.pow(L(2.0), e.cast("double")) > size, e - 1).when(F.pow(L(2.0), e.cast("double") + 1) <= size, e + 1).otherwise(e)
    up = y > x
    outward = up == (x > 0)
    at_power = F.pow(L(2.0), e.cast("double")) == size
    # Below a power of two the places are half as wide; under 2 ** -1022 they stay as they are.
    place = F.greatest(L(tiny), F.pow(L(2.0), F.greatest(e - 52 - F.when(at_power & ~outward, 1).otherwise(0), L(-1074)).cast("double")))
    step = F.when(x == 0, F.when(up, tiny).otherwise(-tiny)).otherwise(x + F.when(up, place).otherwise(-place))
    infinite = size == math.inf
    return F.when(F.isnan(x) | F.isnan(y), math.nan).when(x == y, y).when(infinite, F.signum(x) * float.fromhex("0x1.fffffffffffffp+1023")).otherwise(step)


def softplus(x):
    return fmax(x, L(0.0)) + F.log1p(F.exp(-F.abs(x)))


def gelu(x):
    return 0.5 * x * (1.0 + F.tanh(math.sqrt(2.0 / math.pi) * (x + 0.044715 * x * x * x)))


def gelu_grad(x):
    k = math.sqrt(2.0 / math.pi)
    t = F.tanh(k * (x + 0.044715 * x * x * x))
    return 0.5 * (1.0 + t) + 0.5 * x * (1.0 - t * t) * k * (1.0 + 3 * 0.044715 * x * x)


UNARY: dict[str, object] = {
    "neg": lambda x: -x,
    "abs": F.abs,
    "sign": sign,
    "square": lambda x: x * x,
    "reciprocal": lambda x: ieee_div(L(1.0), x),
    "floor": floor,
    "ceil": ceil,
    "round": lambda x: F.round(x, 0),
    "rint": F.rint,
    "trunc": trunc,
    "frac": lambda x: x - trunc(x),
    "exp": F.exp,
    "exp2": lambda x: F.pow(L(2.0), x),
    "exp10": lambda x: F.pow(L(10.0), x),
    "expm1": F.expm1,
    "ln": ieee_ln,
    "log2": ieee_log2,
    "log10": ieee_log10,
    "log1p": ieee_log1p,
    "sqrt": F.sqrt,
    "rsqrt": lambda x: ieee_div(L(1.0), F.sqrt(x)),
    "cbrt": F.cbrt,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": lambda x: 0.5 * (ieee_log1p(x) - ieee_log1p(-x)),
    "degrees": F.degrees,
    "radians": F.radians,
    "sinc": sinc,
    "sinpi": lambda x: F.sin(math.pi * x),
    "entr": entr,
    "logit": logit,
    "expit": sigmoid,
    "relu": lambda x: fmax(x, L(0.0)),
    "relu6": lambda x: clamp(x, 0.0, 6.0),
    "relu_squared": lambda x: fmax(x, L(0.0)) * fmax(x, L(0.0)),
    "sigmoid": sigmoid,
    "logsigmoid": lambda x: -softplus(-x),
    "hardsigmoid": lambda x: clamp(x / 6.0 + 0.5, 0.0, 1.0),
    "hardtanh": lambda x: clamp(x, -1.0, 1.0),
    "selu": lambda x: SELU_SCALE * F.when(above(x, 0), x).otherwise(SELU_ALPHA * F.expm1(x)),
    "gelu": gelu,
    "silu": lambda x: x * sigmoid(x),
    "mish": lambda x: x * F.tanh(softplus(x)),
    "softplus": softplus,
    "hardswish": lambda x: x * clamp(x + 3.0, 0.0, 6.0) / 6.0,
    "squareplus": lambda x: 0.5 * (x + F.sqrt(x * x + 4.0)),
    "shifted_softplus": lambda x: softplus(x) - math.log(2.0),
    "softsign": lambda x: x / (1.0 + F.abs(x)),
    "tanhshrink": lambda x: x - F.tanh(x),
    "relu_grad": lambda x: F.when(above(x, 0), 1.0).otherwise(0.0),
    "sigmoid_grad": lambda x: sigmoid(x) * (1.0 - sigmoid(x)),
    "tanh_grad": lambda x: 1.0 - F.tanh(x) * F.tanh(x),
    "elu_grad": lambda x: F.when(above(x, 0), 1.0).otherwise(F.exp(x)),
    "silu_grad": lambda x: sigmoid(x) * (1.0 + x * (1.0 - sigmoid(x))),
    "gelu_grad": gelu_grad,
    "softplus_grad": sigmoid,
}

BINARY: dict[str, object] = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": ieee_div,
    "pow": power,
    "fmod": fmod,
    "remainder": floormod,
    "floor_divide": lambda x, y: floor(ieee_div(x, y)),
    "atan2": F.atan2,
    "hypot": F.hypot,
    "copysign": copysign,
    "ldexp": lambda x, y: x * F.pow(L(2.0), y),
    "nextafter": next_after,
    "maximum": fmax,
    "minimum": fmin,
    "logaddexp": logaddexp,
    "logaddexp2": logaddexp2,
    "heaviside2": lambda x, y: heaviside(x, y),
    "xlogy": xlogy,
    "xlog1py": xlog1py,
    "squared_difference": lambda x, y: (x - y) * (x - y),
    "swiglu": lambda x, y: x * sigmoid(x) * y,
    "geglu": lambda x, y: gelu(x) * y,
    "glu": lambda x, y: x * sigmoid(y),
    "reglu": lambda x, y: fmax(x, L(0.0)) * y,
    "prelu": lambda x, y: F.when(above(x, 0), x).otherwise(x * y),
}

#: Functions with parameters beside their inputs.
PARAMETRIC: dict[str, object] = {
    "add_scalar": lambda x, c: x + c,
    "sub_scalar": lambda x, c: x - c,
    "rsub_scalar": lambda x, c: c - x,
    "scale": lambda x, c: x * c,
    "div_scalar": lambda x, c: ieee_div(x, L(float(c))),
    "rdiv_scalar": lambda x, c: ieee_div(L(float(c)), x),
    "pow_scalar": lambda x, c: power(x, L(float(c))),
    "scaled_exp": lambda x, c: F.exp(c * x),
    "clamp": clamp,
    "heaviside": lambda x, at_zero: heaviside(x, L(float(at_zero))),
    "leaky_relu": lambda x, slope: F.when(above(x, 0), x).otherwise(slope * x),
    "leaky_relu_grad": lambda x, slope: F.when(above(x, 0), 1.0).otherwise(slope),
    "thresholded_relu": lambda x, at: F.when(above(x, at), x).otherwise(0.0),
    "star_relu": lambda x, scale, bias: scale * fmax(x, L(0.0)) * fmax(x, L(0.0)) + bias,
    "elu": lambda x, alpha: F.when(above(x, 0), x).otherwise(alpha * F.expm1(x)),
    "celu": lambda x, alpha: fmax(x, L(0.0)) + fmin(L(0.0), alpha * F.expm1(x / alpha)),
    "softshrink": lambda x, at: F.when(above(x, at), x - at).when(x < -at, x + at).otherwise(0.0),
    "hardshrink": lambda x, at: F.when(above(F.abs(x), at), x).otherwise(0.0),
    "scaled_add": lambda x, y, c: x * c + y,
    "scaled_sub": lambda x, y, c: (x - y) * c,
}


def apply_unary(name: str, x: Column) -> Column:
    return UNARY[name](x)


def apply_binary(name: str, x: Column, y: Column) -> Column:
    return BINARY[name](x, y)


def crelu(v: Column) -> Column:
    """An array followed by its negative, both without what is below zero."""
    return F.concat(F.transform(v, lambda x: fmax(x, L(0.0))), F.transform(v, lambda x: fmax(-x, L(0.0))))
