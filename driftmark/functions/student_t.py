"""Student t probabilities as Spark columns, by one method for all degrees of freedom.

The density is integrated by Gauss-Legendre panels. In the variable s = asinh(t) it is smooth and
falls off fast for few and for many degrees of freedom alike, so a fixed set of nodes serves them all.
"""
from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PANELS, NODES = 8, 20
# Expansion of Gamma(x + 1/2) / (Gamma(x) sqrt(x)) in 1/x.
GAMMA_RATIO = (1.0, -1 / 8, 1 / 128, 5 / 1024, -21 / 32768, -399 / 262144, 869 / 4194304, 39325 / 33554432)
# The expansion is used this far up and brought down by the recurrence.
SHIFT = 16


def _nodes() -> list[tuple[float, float]]:
    """(place, weight) on the unit interval."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    return [((p + (a + 1) / 2) / PANELS, b / 2 / PANELS) for p in range(PANELS) for a, b in zip(x.tolist(), w.tolist())]


def _numbers(values: Iterable[float]) -> Column:
    """An array of doubles, as one text: hundreds of literals take the driver seconds to put together and to analyse."""
    return F.expr(f"transform(split('{' '.join(map(repr, values))}', ' '), v -> CAST(v AS DOUBLE))")


def _gamma_ratio(x: Column) -> Column:
    """Gamma(x + 1/2) / Gamma(x)."""
    high = x + SHIFT
    series = F.aggregate(_numbers(reversed(GAMMA_RATIO)), F.lit(0.0), lambda s, c: s / high + c)
    return F.sqrt(high) * F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), series, lambda s, k: s * ((x + k) / (x + k + 0.5)))


def central_mass(t: Column, df: Column) -> Column:
    """P(|T| <= |t|)."""
    nu = df.cast("double")
    end = F.asinh(F.abs(t.cast("double")))
    places, weights = map(_numbers, zip(*_nodes()))

    def density(x: Column, w: Column) -> Column:
        u = F.sinh(end * x)
        return w * F.cosh(end * x) * F.exp(-(nu + 1) / 2 * F.log1p(u * u / nu))

    mass = 2 * end * F.aggregate(F.zip_with(places, weights, density), F.lit(0.0), lambda total, y: total + y) * _gamma_ratio(nu / 2) / F.sqrt(nu * math.pi)
    return F.least(mass, F.lit(1.0))


def two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value; null when t or df is null or df < 1."""
    return F.when((df >= 1) & t.isNotNull(), 1 - central_mass(t, df))


def critical_975(df: Column) -> Column:
    """97.5% quantile, by bisection."""
    def halve(acc: Column, _: Column) -> Column:
        middle = (acc["low"] + acc["high"]) / 2
        under = central_mass(middle, df) < 0.95
        return F.struct(F.when(under, middle).otherwise(acc["low"]).alias("low"),
                        F.when(under, acc["high"]).otherwise(middle).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(48)), F.struct(F.lit(0.0).alias("low"), F.lit(16.0).alias("high")),
                        halve, lambda acc: (acc["low"] + acc["high"]) / 2)
    return F.when(df >= 1, found)
