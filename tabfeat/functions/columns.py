"""Reusable column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
INTEGRALS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERICS = (*FLOATS, *INTEGRALS, T.DecimalType)


def numeric(df: DataFrame, name: str) -> Column:
    """The column as a double, with NaN turned into NULL."""
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOATS):
        value = F.when(~F.isnan(value), value)
    return value.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, FLOATS):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def q(name: str) -> Column:
    """A column whose name may hold dots or start with a digit."""
    return F.col(f"`{name}`")


def any_of(*conditions: Column) -> Column:
    """OR of predicates in which a missing operand counts as False."""
    return reduce(or_, [F.coalesce(c, F.lit(False)) for c in conditions])


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Sum of columns times weights; one missing operand makes the result missing."""
    terms = [q(c) if w == 1 else q(c) * F.lit(float(w)) for c, w in weights.items()]
    return reduce(add, terms)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def count_below(value: Column, marks: Column, most: int, strict: bool) -> Column:
    """How many of at most ``most`` sorted marks are < (or <=) the value, by binary search."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def probe(at: Column, step: Column) -> Column:
        mark = F.get(marks, at + step - 1)
        passed = mark < value if strict else mark <= value
        return F.when(F.coalesce(passed, F.lit(False)), at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), probe)


def right_closed_bin(value: Column, edges: Sequence[int]) -> Column:
    """Label of the interval ``(lo, hi]`` holding the value, NULL outside all."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:]))):
        out = F.when((value > lo) & (value <= hi), F.lit(f"({lo}, {hi}]")).otherwise(out)
    return out


def hat_basis(value: Column, knots: Sequence[float]) -> list[Column]:
    """Degree-one B-spline basis over ``knots``; the first function is left out."""
    out = []
    for i in range(1, len(knots)):
        left, mid = knots[i - 1], knots[i]
        rise = (value - F.lit(left)) / F.lit(mid - left)
        if i + 1 < len(knots):
            fall = (F.lit(knots[i + 1]) - value) / F.lit(knots[i + 1] - mid)
            rise = F.least(rise, fall)
        out.append(F.when(value.isNotNull(), F.greatest(rise, F.lit(0.0))))
    return out


def polynomial(value: Column, coefficients: Sequence[float]) -> Column:
    """Horner form, highest power first."""
    return reduce(lambda acc, c: acc * value + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


# Rational approximation of the normal quantile (Acklam), relative error 1.2e-9.
PROBIT_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PROBIT_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01, 1.0]
PROBIT_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PROBIT_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00, 1.0]
PROBIT_TAIL = 0.02425

# Normal distribution function (Hart 1968 as given by West 2005), highest power first.
NORMAL_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
              112.079291497871, 221.213596169931, 220.206867912376]
NORMAL_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
              296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]


def probit(p: Column) -> Column:
    """Standard normal quantile of ``0 < p < 1``."""
    r = (p - 0.5) * (p - 0.5)
    centre = (p - 0.5) * polynomial(r, PROBIT_A) / polynomial(r, PROBIT_B)
    t = F.sqrt(F.log(F.least(p, 1 - p)) * -2.0)
    tail = polynomial(t, PROBIT_C) / polynomial(t, PROBIT_D)
    return F.when(p < PROBIT_TAIL, tail).when(p > 1 - PROBIT_TAIL, -tail).otherwise(centre)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function."""
    a = F.least(F.abs(z), F.lit(7.07))
    upper = F.exp(a * a * -0.5) * polynomial(a, NORMAL_NUM) / polynomial(a, NORMAL_DEN)
    return F.when(z > 0, 1 - upper).otherwise(upper)
