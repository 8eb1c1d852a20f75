"""Rounding and tail probabilities written as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int) -> Column:
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def bounded(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, or 0.0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def rate(flag: Column) -> Column:
    """Mean of a boolean as an aggregate."""
    return F.avg(flag.cast("int"))


def erf(x: Column) -> Column:
    """Error function for x ≥ 0 by its all-positive series, exact to double precision."""
    capped = F.least(x, F.lit(6.0))
    start = F.struct(capped.alias("term"), capped.alias("sum"))
    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(180)),
        start,
        lambda acc, n: F.struct(
            (acc["term"] * capped * capped * 2.0 / (n * 2.0 + 1.0)).alias("term"),
            (acc["sum"] + acc["term"] * capped * capped * 2.0 / (n * 2.0 + 1.0)).alias("sum"),
        ),
    )
    return F.least(F.lit(1.0), state["sum"] * F.exp(-capped * capped) * (2.0 / math.sqrt(math.pi)))


def normal_two_sided_p(z: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - erf(F.abs(z) / math.sqrt(2.0)))


def student_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for whole degrees of freedom, by the closed form."""
    theta = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    cos2 = F.pow(F.cos(theta), F.lit(2.0))
    odd = dof % 2 == 1
    first = F.when(odd, F.lit(3)).otherwise(F.lit(2))
    steps = F.when(first <= dof - 2, F.sequence(first.cast("int"), (dof - 2).cast("int"), F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    one = F.struct(F.lit(1.0).alias("c"), F.lit(1.0).alias("s"))
    series = F.aggregate(
        steps,
        one,
        lambda acc, j: F.struct(
            (acc["c"] * cos2 * (j - 1) / j).alias("c"),
            (acc["s"] + acc["c"] * cos2 * (j - 1) / j).alias("s"),
        ),
    )["s"]
    odd_tail = F.when(dof == 1, theta).otherwise(theta + F.sin(theta) * F.cos(theta) * series)
    p = F.when(odd, F.lit(1.0) - odd_tail * (2.0 / math.pi)).otherwise(F.lit(1.0) - F.sin(theta) * series)
    return F.greatest(F.lit(0.0), p)


def chi_square_tail_p(statistic: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution for whole degrees of freedom."""
    half = statistic / 2.0
    odd = dof % 2 == 1
    root = F.sqrt(half)
    first_odd = root * (2.0 / math.sqrt(math.pi)) * F.exp(-half)
    terms = F.floor((dof - F.when(odd, F.lit(1)).otherwise(F.lit(0))) / 2).cast("int")
    start = F.struct(
        F.when(odd, first_odd).otherwise(F.exp(-half)).alias("term"), F.lit(0.0).alias("sum")
    )
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    steps = F.when(terms >= 1, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    partial = F.aggregate(
        steps,
        start,
        lambda acc, i: F.struct(
            (acc["term"] * half / (i + shift)).alias("term"),
            (acc["sum"] + acc["term"]).alias("sum"),
        ),
    )["sum"]
    return F.when(odd, F.lit(1.0) - erf(root) + partial).otherwise(partial)
