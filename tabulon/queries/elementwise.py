"""Elementwise functions, activations, losses and predicates over whole tables, a group of functions to a query."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tabulon.catalog import register
from tabulon.functions import guards
from tabulon.functions.losses import LOSSES, PROBABILITY_LOSSES
from tabulon.functions.scalar import BINARY, PARAMETRIC, SELU_ALPHA, SELU_SCALE, UNARY, crelu
from tabulon.session import table

SIG = "(1/(1+exp(-({0}))))"
SP = "(greatest({0},0)+ln(1+exp(-abs({0}))))"
GELU = f"(0.5*({{0}})*(1+tanh({math.sqrt(2 / math.pi)!r}*(({{0}})+0.044715*({{0}})*({{0}})*({{0}})))))"

#: DuckDB counterparts of the unary functions.
UNARY_SQL = {
    "neg": "-x", "abs": "abs(x)", "sign": "sign(x)", "square": "x*x", "reciprocal": "1/x", "floor": "floor(x)", "ceil": "ceil(x)", "round": "round(x)", "rint": "round_even(x,0)", "trunc": "trunc(x)", "frac": "x-trunc(x)",
    "exp": "exp(x)", "exp2": "power(2,x)", "exp10": "power(10,x)", "expm1": "exp(x)-1", "ln": "ln(x)", "log2": "log2(x)", "log10": "log10(x)", "log1p": "ln(1+x)",
    "sqrt": "sqrt(x)", "rsqrt": "1/sqrt(x)", "cbrt": "cbrt(x)", "sin": "sin(x)", "cos": "cos(x)", "tan": "tan(x)", "asin": "asin(x)", "acos": "acos(x)", "atan": "atan(x)", "sinh": "sinh(x)", "cosh": "cosh(x)",
    "tanh": "tanh(x)", "asinh": "asinh(x)", "acosh": "acosh(x)", "atanh": "atanh(x)", "degrees": "degrees(x)", "radians": "radians(x)", "sinc": "CASE WHEN x=0 THEN 1 ELSE sin(pi()*x)/(pi()*x) END", "sinpi": "sin(pi()*x)",
    "entr": "CASE WHEN x>0 THEN -x*ln(x) WHEN x=0 THEN 0 ELSE '-inf'::DOUBLE END", "logit": "ln(x/(1-x))", "expit": SIG.format("x"),
    "relu": "greatest(x,0)", "relu6": "least(greatest(x,0),6)", "relu_squared": "greatest(x,0)*greatest(x,0)",
    "sigmoid": SIG.format("x"), "logsigmoid": "-" + SP.format("(-x)"), "hardsigmoid": "least(greatest(x/6+0.5,0),1)", "hardtanh": "least(greatest(x,-1),1)",
    "selu": f"{SELU_SCALE}*CASE WHEN x>0 THEN x ELSE {SELU_ALPHA}*(exp(x)-1) END", "gelu": GELU.format("x"), "silu": "x*" + SIG.format("x"), "mish": f"x*tanh({SP.format('x')})",
    "softplus": SP.format("x"), "hardswish": "x*least(greatest(x+3,0),6)/6", "squareplus": "0.5*(x+sqrt(x*x+4))", "shifted_softplus": SP.format("x") + "-ln(2)", "softsign": "x/(1+abs(x))", "tanhshrink": "x-tanh(x)",
    "relu_grad": "CASE WHEN x>0 THEN 1 ELSE 0 END",
    "sigmoid_grad": f"{SIG.format('x')}*(1-{SIG.format('x')})", "tanh_grad": "1-tanh(x)*tanh(x)", "elu_grad": "CASE WHEN x>0 THEN 1 ELSE exp(x) END", "silu_grad": f"{SIG.format('x')}*(1+x*(1-{SIG.format('x')}))",
    "gelu_grad": "0.5*(1+tanh(@k*(x+0.044715*x*x*x)))+0.5*x*(1-tanh(@k*(x+0.044715*x*x*x))*tanh(@k*(x+0.044715*x*x*x)))*@k*(1+0.134145*x*x)".replace("@k", repr(math.sqrt(2 / math.pi))), "softplus_grad": SIG.format("x"),
}
BINARY_SQL = {
    "add": "x+y", "sub": "x-y", "mul": "x*y", "div": "CASE WHEN y<>0 THEN x/y WHEN x=0 THEN 'nan'::DOUBLE ELSE sign(x)*'inf'::DOUBLE END", "pow": "power(x,y)", "fmod": "x%z", "remainder": "x-floor(x/z)*z", "floor_divide": "floor(x/z)", "atan2": "atan2(x,y)",
    "hypot": "sqrt(x*x+y*y)", "copysign": "CASE WHEN y<0 THEN -abs(x) ELSE abs(x) END", "ldexp": "x*power(2,y)", "maximum": "greatest(x,y)", "minimum": "least(x,y)",
    "logaddexp": "greatest(x,y)+ln(1+exp(-abs(x-y)))", "logaddexp2": "greatest(x,y)+log2(1+power(2,-abs(x-y)))", "heaviside2": "CASE WHEN x<0 THEN 0 WHEN x>0 THEN 1 ELSE y END", "xlogy": "CASE WHEN x=0 THEN 0 ELSE x*ln(y) END",
    "xlog1py": "CASE WHEN x=0 THEN 0 ELSE x*ln(1+y) END", "squared_difference": "(x-y)*(x-y)", "swiglu": f"x*{SIG.format('x')}*y", "geglu": GELU.format("x") + "*y", "glu": f"x*{SIG.format('y')}", "reglu": "greatest(x,0)*y",
    "prelu": "CASE WHEN x>0 THEN x ELSE x*y END",
    "nextafter": "CASE WHEN x=y THEN 0 WHEN y>x THEN 1 ELSE -1 END",
}
LOSS_SQL = {
    "mse": "(x-t)*(x-t)", "mse_grad": "x-t", "mae": "abs(x-t)", "mae_grad": "sign(x-t)", "smooth_l1": "CASE WHEN abs(x-t)<0.5 THEN 0.5*(x-t)*(x-t)/0.5 ELSE abs(x-t)-0.25 END",
    "huber": "CASE WHEN abs(x-t)<=1 THEN 0.5*(x-t)*(x-t) ELSE abs(x-t)-0.5 END", "huber_grad": "least(greatest(x-t,-1),1)", "log_cosh": "abs(x-t)+ln(1+exp(-2*abs(x-t)))-ln(2)", "bce_with_logits": "greatest(x,0)-x*t+ln(1+exp(-abs(x)))",
    "bce_logits_grad": SIG.format("x") + "-t", "poisson_nll": "exp(x)-t*x", "quantile": "greatest(0.9*(t-x),-0.1*(t-x))", "hinge": "greatest(0,1-(2*t-1)*x)", "hinge_grad": "CASE WHEN (2*t-1)*x<1 THEN -(2*t-1) ELSE 0 END",
    "gaussian_logprob": f"-0.5*(x-t)*(x-t)-{0.5 * math.log(2 * math.pi)!r}", "vae_kl": "0.5*(x*x+exp(t)-t-1)",
}
PROB_SQL = {
    "bce": "-(t*ln(p)+(1-t)*ln(1-p))", "bce_grad": "(p-t)/(p*(1-p))", "focal": "-CASE WHEN t>=0.5 THEN 0.25*power(1-p,2)*ln(p) ELSE 0.75*power(p,2)*ln(1-p) END", "kl_div": "CASE WHEN t>0 THEN t*(ln(t)-ln(p)) ELSE 0 END",
    "focal_grad": "CASE WHEN t>0.5 THEN 0.25*(2*(1-p)*ln(p)-power(1-p,2)/p) ELSE -0.25*(2*p*ln(1-p)-power(p,2)/(1-p)) END", "tweedie": "-t*power(p,-0.5)/(-0.5)+power(p,0.5)/0.5", "logloss_hess": "least(greatest(p*(1-p),1e-3),1e6)", "logloss_grad": "p-t",
}

#: Inputs in the domain of functions that are not defined everywhere; all others take x, or (x, y).
INPUTS = {"ln": "w", "log2": "w", "log10": "w", "log1p": "w", "sqrt": "w", "rsqrt": "w", "acosh": "w", "asin": "u", "acos": "u", "atanh": "u", "logit": "p", "pow": "w", "fmod": "z", "remainder": "z", "floor_divide": "z", "xlogy": "z", "xlog1py": "z"}
#: Parameters and DuckDB counterparts of the functions with parameters.
PARAMETER_SQL = {
    "add_scalar": ((1.25,), "x+1.25"), "sub_scalar": ((0.75,), "x-0.75"), "rsub_scalar": ((2.0,), "2-x"), "scale": ((-3.0,), "x*-3"), "div_scalar": ((4.0,), "x/4"), "rdiv_scalar": ((2.0,), "CASE WHEN x=0 THEN 'inf'::DOUBLE ELSE 2/x END"),
    "pow_scalar": ((3.0,), "power(x,3)"), "scaled_exp": ((0.5,), "exp(0.5*x)"), "clamp": ((-0.7, 1.3), "least(greatest(x,-0.7),1.3)"), "heaviside": ((0.25,), "CASE WHEN x<0 THEN 0 WHEN x>0 THEN 1 ELSE 0.25 END"),
    "leaky_relu": ((0.2,), "CASE WHEN x>0 THEN x ELSE 0.2*x END"), "leaky_relu_grad": ((0.2,), "CASE WHEN x>0 THEN 1 ELSE 0.2 END"), "thresholded_relu": ((0.9,), "CASE WHEN x>0.9 THEN x ELSE 0 END"), "star_relu": ((0.9, -0.4), "0.9*greatest(x,0)*greatest(x,0)-0.4"),
    "elu": ((0.8,), "CASE WHEN x>0 THEN x ELSE 0.8*(exp(x)-1) END"), "celu": ((1.3,), "greatest(x,0)+least(0,1.3*(exp(x/1.3)-1))"), "softshrink": ((0.35,), "CASE WHEN x>0.35 THEN x-0.35 WHEN x<-0.35 THEN x+0.35 ELSE 0 END"),
    "hardshrink": ((0.35,), "CASE WHEN abs(x)>0.35 THEN x ELSE 0 END"), "scaled_add": ((1.5,), "x*1.5+y"), "scaled_sub": ((0.25,), "(x-y)*0.25"),
}

BASE_SQL = """WITH b AS (SELECT l_orderkey, l_linenumber, (l_quantity-25.5::DOUBLE)/10 AS x, l_tax*10 AS y, l_tax*10+0.5::DOUBLE AS z, l_discount+0.01::DOUBLE AS p, (l_quantity-25.5::DOUBLE)/30 AS u, abs(l_quantity-25.5::DOUBLE)/10+1 AS w,
  CASE WHEN l_returnflag='R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM lineitem) """


def base(spark, sf_dir):
    c = F.col
    src = table(spark, sf_dir, "lineitem")
    return src.select("l_orderkey", "l_linenumber", ((c("l_quantity") - 25.5) / 10).alias("x"), (c("l_tax") * 10).alias("y"), (c("l_tax") * 10 + 0.5).alias("z"), (c("l_discount") + 0.01).alias("p"), ((c("l_quantity") - 25.5) / 30).alias("u"), (F.abs(c("l_quantity") - 25.5) / 10 + 1).alias("w"), F.when(c("l_returnflag") == "R", 1.0).otherwise(0.0).alias("t"))


def _group(name: str, exprs: dict, sql: dict):
    text = BASE_SQL + "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({sql[k]})::DOUBLE, 6)+0.0 AS {k}" for k in exprs) + " FROM b"

    @register(name, text)
    def query(spark, sf_dir):
        return base(spark, sf_dir).select("l_orderkey", "l_linenumber", *[(F.round(e().cast("double"), 6) + 0.0).alias(k) for k, e in exprs.items()])


def _chunks(prefix: str, names: list[str], size: int, make, sql: dict):
    for k in range(0, len(names), size):
        part = names[k : k + size]
        _group(f"{prefix}_{part[0]}_to_{part[-1]}", {n: (lambda n=n: make(n)) for n in part}, sql)


def _on(sql: str, name: str, own: str) -> str:
    """The SQL of a function with its own input in the place of x (or y for two inputs)."""
    import re

    return re.sub(rf"\b{own}\b", INPUTS.get(name, own), sql)


def _two(name: str):
    x, y = F.col("w" if name == "pow" else "x"), F.col(INPUTS[name] if name in INPUTS and name != "pow" else "y")
    out = BINARY[name](x, y)
    return F.signum(out - x) if name == "nextafter" else out


_chunks("math", list(UNARY), 12, lambda n: UNARY[n](F.col(INPUTS.get(n, "x"))), {n: _on(q, n, "x") for n, q in UNARY_SQL.items()})
_chunks("math2", list(BINARY), 9, _two, {n: _on(q, n, "x") if n == "pow" else q.replace("z", "y") if n not in INPUTS else _on(q, n, "y") for n, q in BINARY_SQL.items()})
_chunks("math_scalar", list(PARAMETRIC), 10, lambda n: PARAMETRIC[n](F.col("x"), *([F.col("y")] if n.startswith("scaled_") and n != "scaled_exp" else []), *PARAMETER_SQL[n][0]), {n: q for n, (_, q) in PARAMETER_SQL.items()})
_chunks("loss", list(LOSSES), 8, lambda n: LOSSES[n](F.col("x"), F.col("t")), LOSS_SQL)
_chunks("loss_prob", list(PROBABILITY_LOSSES), 8, lambda n: PROBABILITY_LOSSES[n](F.col("p"), F.col("t")), PROB_SQL)


#: Numbers among which NaN, infinities and zeros of both signs occur, by line number.
ODD_SQL = """WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag='R' AS t, CASE l_linenumber%7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN '-inf'::DOUBLE WHEN 3 THEN 0.0::DOUBLE ELSE l_quantity-25 END AS x,
  CASE l_orderkey%5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE l_tax*100-4 END AS y FROM lineitem) """


def odd_base(spark, sf_dir):
    c, nan, inf = F.col, F.lit(guards.NAN), F.lit(guards.INF)
    k, o = c("l_linenumber") % 7, c("l_orderkey") % 5
    x = F.when(k == 0, nan).when(k == 1, inf).when(k == 2, -inf).when(k == 3, 0.0).otherwise(c("l_quantity") - 25)
    y = F.when(o == 0, nan).when(o == 1, inf).when(o == 2, 0.0).otherwise(c("l_tax") * 100 - 4)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (c("l_returnflag") == "R").alias("t"), x.alias("x"), y.alias("y"))


_N = "(isnan(x) OR isnan(y))"


@register(
    "predicates_where_compare",
    ODD_SQL + f"""SELECT l_orderkey, l_linenumber, (NOT {_N} AND x > y)::INT::DOUBLE AS gt, (NOT {_N} AND x < y)::INT::DOUBLE AS lt, (NOT {_N} AND x = y)::INT::DOUBLE AS eq, (NOT {_N} AND x >= y)::INT::DOUBLE AS ge, (NOT {_N} AND x <= y)::INT::DOUBLE AS le, ({_N} OR x <> y)::INT::DOUBLE AS ne,
  (NOT isnan(x) AND x > 0.25)::INT::DOUBLE AS gt_scalar, CASE WHEN t THEN x ELSE y END AS where_mask, isnan(x)::INT::DOUBLE AS is_nan, isinf(x)::INT::DOUBLE AS is_inf, isfinite(x)::INT::DOUBLE AS is_finite, (NOT isnan(x) AND x < 0)::INT::DOUBLE AS signbit FROM b""",
)
def predicates(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    cols = [guards.compare(x, op, y).alias(op) for op in ("gt", "lt", "eq", "ge", "le", "ne")]
    nan, inf = F.isnan(x), F.abs(x) == guards.INF
    more = [guards.compare(x, "gt", F.lit(0.25)).alias("gt_scalar"), F.when(F.col("t"), x).otherwise(y).alias("where_mask"), guards.as_flag(nan).alias("is_nan"), guards.as_flag(inf).alias("is_inf"), guards.as_flag(~nan & ~inf).alias("is_finite"), guards.as_flag(guards.signbit(x)).alias("signbit")]
    return odd_base(spark, sf_dir).select("l_orderkey", "l_linenumber", *cols, *more)


@register(
    "math_odd_values",
    ODD_SQL + """SELECT l_orderkey, l_linenumber, CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE greatest(x,y) END AS maximum, CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE least(x,y) END AS minimum,
  CASE WHEN isnan(x) OR x=0 AND y=0 OR isinf(x) AND isinf(y) OR isnan(y) THEN 'nan'::DOUBLE WHEN y=0 THEN sign(x)*'inf'::DOUBLE ELSE x/y END AS div, CASE WHEN isnan(x) OR isnan(y) OR y=0 OR isinf(x) THEN 'nan'::DOUBLE WHEN isinf(y) THEN x ELSE x%y END AS fmod,
  CASE WHEN isnan(x) OR isnan(y) OR x=0 AND y=0 OR isinf(x) AND isinf(y) THEN 'nan'::DOUBLE WHEN y=0 THEN sign(x)*'inf'::DOUBLE WHEN isinf(x) THEN x*sign(y) WHEN isinf(y) THEN 0 ELSE floor(x/y) END AS floor_divide,
  CASE WHEN isfinite(x) THEN floor(x) ELSE x END AS floor, CASE WHEN isnan(x) OR x<0 THEN 'nan'::DOUBLE WHEN x=0 THEN '-inf'::DOUBLE WHEN isinf(x) THEN x ELSE round(ln(x),9) END AS ln, CASE WHEN isnan(x) OR x<0 THEN 'nan'::DOUBLE WHEN isinf(x) THEN x ELSE round(sqrt(x),9) END AS sqrt,
  CASE WHEN isnan(x) OR x<0 THEN 0 ELSE x END AS relu, CASE WHEN isnan(x) OR abs(x)>1 THEN 'nan'::DOUBLE ELSE round(asin(x),9) END AS asin, CASE WHEN isnan(x) THEN 0 ELSE sign(x) END AS sign FROM b""",
)
def odd_values(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    two = [(BINARY[n](x, y) + 0.0).alias(n) for n in ("maximum", "minimum", "div", "fmod", "floor_divide")]
    one = [((F.round(UNARY[n](x), 9) if n in ("ln", "sqrt", "asin") else UNARY[n](x)) + 0.0).alias(n) for n in ("floor", "ln", "sqrt", "relu", "asin", "sign")]
    return odd_base(spark, sf_dir).select("l_orderkey", "l_linenumber", *two, *one)


@register("activation_crelu", "SELECT vec_id, j, round(x,6) AS x FROM (SELECT vec_id, unnest(list_concat(list_transform(embedding::DOUBLE[], lambda a: greatest(a,0)), list_transform(embedding::DOUBLE[], lambda a: greatest(-a,0)))) AS x, generate_subscripts(list_concat(embedding,embedding),1)-1 AS j FROM embeddings)")
def crelu_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(crelu(F.col("embedding").cast("array<double>"))).alias("j", "x")).withColumn("x", F.round("x", 6) + 0.0)
