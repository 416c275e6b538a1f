"""Hazards: the rate at which a state of a given age is left, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A hazard takes age and pressure and gives a rate.
Hazard = Callable[[Column, Column], Column]

LEAST_AGE = 1e-10


def rational_series(n: int) -> tuple[float, list[float]]:
    """Weideman's expansion of the scaled error function: its length L, and n coefficients of powers of (L - z) / (L + z).

    They are the Fourier coefficients of exp(-t^2) (L^2 + t^2) with t = L tan(angle / 2).
    """
    length, angles = math.sqrt(n / math.sqrt(2)), np.arange(1 - 2 * n, 2 * n) * math.pi / (2 * n)
    t = length * np.tan(angles / 2)
    values = np.r_[0, np.exp(-t * t) * (length * length + t * t)]
    return length, (np.fft.fft(np.fft.fftshift(values)).real / (4 * n))[1 : n + 1].tolist()


LENGTH, SERIES = rational_series(36)


def erfcx(z: Column) -> Column:
    """exp(z^2) erfc(z) with a relative error below 1e-13. z and the series are evaluated once a row: a lambda's variable is never inlined."""
    series = F.array(*(F.lit(c) for c in reversed(SERIES)))

    def right(x: Column) -> Column:
        total = F.transform(F.array((LENGTH - x) / (LENGTH + x)), lambda r: F.aggregate(series, F.lit(0.0), lambda sum_, c: c + r * sum_))[0]
        return (2 * total / (LENGTH + x) + 1 / math.sqrt(math.pi)) / (LENGTH + x)

    signed = lambda z: F.transform(F.array(right(F.abs(z))), lambda y: F.when(z >= 0, y).otherwise(2 * F.exp(z * z) - y))[0]
    return F.transform(F.array(z), signed)[0]


def lognormal_parameters(mean: float, median: float) -> tuple[float, float]:
    """mu and sigma of the log-normal distribution with this mean and median."""
    if not (math.isfinite(mean) and math.isfinite(median) and mean > median > 0):
        raise ValueError("a log-normal dwell time needs mean > median > 0")
    return math.log(median), math.sqrt(2 * math.log(mean / median))


def lognormal(age: Column, mu: float, sigma: float) -> Column:
    t = F.greatest(age, F.lit(LEAST_AGE))
    z = (F.log(t) - mu) / (sigma * math.sqrt(2))
    return math.sqrt(2 / math.pi) / (t * sigma * F.greatest(erfcx(z), F.lit(1e-30)))


def weibull(age: Column, shape: float, scale: float) -> Column:
    return F.lit(shape / scale) * F.pow(F.greatest(age, F.lit(LEAST_AGE)) / scale, F.lit(shape - 1))


def gamma(age: Column, shape: float, scale: float, terms: int = 96) -> Column:
    """Density over survival. Below the mean survival comes from a power series, above it from a continued fraction, in which the density cancels."""
    x = F.greatest(age, F.lit(LEAST_AGE)) / scale
    density = F.exp((shape - 1) * F.log(x) - x - math.lgamma(shape)) / scale
    series = F.lit(1.0)
    for n in range(terms, 0, -1):
        series = 1 + x / (shape + n) * series
    reached = F.exp(shape * F.log(x) - x - math.lgamma(shape + 1)) * series
    fraction = x + (2 * terms + 1 - shape)
    for n in range(terms, 0, -1):
        fraction = x + (2 * n - 1 - shape) - n * (n - shape) / fraction
    return F.when(x < shape + 1, density / F.greatest(1 - reached, F.lit(1e-300))).otherwise(fraction / (x * scale))


def hazard(kind: str, **p: float) -> Hazard:
    """A hazard by name: lognormal (mean, median), weibull (shape, scale), gamma (shape, scale), constant (rate), network (beta)."""
    makers: dict[str, tuple[set[str], Callable[..., Hazard]]] = {
        "lognormal": ({"mean", "median"}, lambda mean, median: (lambda mu, sigma: lambda age, pressure: lognormal(age, mu, sigma))(*lognormal_parameters(mean, median))),
        "weibull": ({"shape", "scale"}, lambda shape, scale: lambda age, pressure: weibull(age, shape, scale)),
        "gamma": ({"shape", "scale"}, lambda shape, scale: lambda age, pressure: gamma(age, shape, scale)),
        "constant": ({"rate"}, lambda rate: lambda age, pressure: F.lit(float(rate))),
        "network": ({"beta"}, lambda beta: lambda age, pressure: beta * pressure),
    }
    if kind not in makers or set(p) != makers[kind][0]:
        raise ValueError(f"{kind}: a hazard is one of " + ", ".join(f"{k}({', '.join(sorted(v[0]))})" for k, v in makers.items()))
    if any(not math.isfinite(v) or v < 0 or v == 0 and k != "rate" and k != "beta" for k, v in p.items()):
        raise ValueError("hazard parameters are positive and finite")
    return makers[kind][1](**p)
