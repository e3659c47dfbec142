"""IEEE behaviour on top of ANSI Spark: division, logarithms, strict parsing, truncation and floor-mod.

Inside Spark a missing value is NULL; these helpers give infinities and NaN where IEEE arithmetic has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: What a number looks like; nothing is trimmed.
NUMBER = r"^[+-]?((?i:inf|infinity|nan)|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"


def signbit(x: Column) -> Column:
    """Whether the sign is negative, -0.0 included; false for NaN."""
    return F.coalesce((x < 0) | ((x == 0) & x.cast("double").cast("string").startswith("-")), F.lit(False))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with x/0 = signed infinity and 0/0 = NaN."""
    a, b = a.cast("double"), b.cast("double")
    infinite = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a < 0) != signbit(b), F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(b != 0, F.try_divide(a, b)).when(a.isNotNull() & b.isNotNull(), infinite)


def above(x: Column, y) -> Column:
    """x > y, false where x is NaN (Spark holds NaN for the largest number)."""
    return (x > y) & ~F.isnan(x)


def fmax(x: Column, y: Column) -> Column:
    """The larger one; a number wins against NaN."""
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


def fmin(x: Column, y: Column) -> Column:
    """The smaller one; a number wins against NaN, which Spark holds for the largest."""
    return F.least(x, y)


def _whole(x: Column, fn) -> Column:
    """fn, which returns a long, of a double of any size: from 2 ** 52 on all doubles are whole."""
    x = x.cast("double")
    return F.when(F.abs(x) < float(1 << 52), fn(x).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return _whole(x, F.floor)


def ceil(x: Column) -> Column:
    return _whole(x, F.ceil)


def _log(x: Column, fn) -> Column:
    x = x.cast("double")
    return F.when(x > 0, fn(x)).when(x == 0, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def ieee_ln(x: Column) -> Column:
    return _log(x, F.ln)


def ieee_log2(x: Column) -> Column:
    return _log(x, F.log2)


def ieee_log10(x: Column) -> Column:
    return _log(x, F.log10)


def ieee_log1p(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(-INF)).when(x.isNotNull(), F.lit(NAN))


def strict_double(s: Column) -> Column:
    """A cell as a double, NULL unless the whole untrimmed cell is a number."""
    low = F.lower(s)
    word = F.regexp_extract(low, r"^[+-]?(inf|infinity|nan)$", 1)
    value = F.when(word == "nan", F.lit(NAN)).when(word != "", F.when(s.startswith("-"), F.lit(-INF)).otherwise(F.lit(INF))).otherwise(s.try_cast("double"))
    return F.when(s.rlike(NUMBER), value)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def floormod(x: Column, y: Column) -> Column:
    """x - floor(x / y) * y; NaN for a zero divisor."""
    return x - floor(ieee_div(x, y)) * y


def fmod(x: Column, y: Column) -> Column:
    """The remainder with the sign of x; NaN for a zero divisor."""
    return F.when(y != 0, x % y).when(x.isNotNull() & y.isNotNull(), F.lit(NAN))


def as_flag(cond: Column) -> Column:
    return cond.cast("double")


def compare(a: Column, op: str, b: Column) -> Column:
    """1.0 or 0.0; a comparison with NaN is false, except that NaN differs from everything."""
    nan = F.isnan(a) | F.isnan(b)
    made = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b, "eq": a == b, "ne": a != b}[op]
    return as_flag(F.when(nan, F.lit(op == "ne")).otherwise(made))
