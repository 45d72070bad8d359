"""Special functions Spark lacks, as Column expressions or small tables."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

from .columns import as_doubles, total

# Lanczos coefficients for g = 7, n = 9.
LANCZOS = [
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
]


def gamma(k: Column) -> Column:
    """Gamma function for positive arguments."""
    # the recurrence moves arguments below 1/2 into the accurate range
    small = k < 0.5
    z = F.when(small, k).otherwise(k - 1.0)
    series = F.lit(LANCZOS[0]) + total(
        [F.lit(c) / (z + float(i + 1)) for i, c in enumerate(LANCZOS[1:])]
    )
    t = z + 7.5
    value = F.sqrt(F.lit(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * series
    return F.when(small, value / k).otherwise(value)


WEIDEMAN_N = 32


@lru_cache(maxsize=None)
def weideman(n: int = WEIDEMAN_N) -> tuple[float, tuple[float, ...]]:
    """Scale and polynomial coefficients of the rational series for w(z)
    (Weideman 1994), lowest power first."""
    m = 2 * n
    scale = math.sqrt(n / math.sqrt(2.0))
    theta = np.arange(-m + 1, m) * np.pi / m
    t = scale * np.tan(theta / 2)
    f = np.concatenate([[0.0], np.exp(-(t**2)) * (scale**2 + t**2)])
    a = np.real(np.fft.fft(np.fft.fftshift(f))) / (2 * m)
    return scale, tuple(float(v) for v in a[1 : n + 1])


def faddeeva_real(x: Column, y: Column) -> Column:
    """Real part of w(x + iy) for y >= 0."""
    scale, coefs = weideman()
    # Z = (L + iz) / (L - iz), with iz = -y + ix
    den_re, den_im = F.lit(scale) + y, -x
    num_re, num_im = F.lit(scale) - y, x
    norm = den_re * den_re + den_im * den_im
    point = F.struct(
        ((num_re * den_re + num_im * den_im) / norm).alias("re"),
        ((num_im * den_re - num_re * den_im) / norm).alias("im"),
    )
    start = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))

    def horner(acc: Column, c: Column) -> Column:
        p = c.getField("p")
        return F.struct(
            (
                acc.getField("re") * p.getField("re")
                - acc.getField("im") * p.getField("im")
                + c.getField("a")
            ).alias("re"),
            (
                acc.getField("re") * p.getField("im")
                + acc.getField("im") * p.getField("re")
            ).alias("im"),
        )

    # the point travels with the coefficients, so each is computed once a row
    steps = F.transform(
        F.array(point),
        lambda p: F.aggregate(
            F.transform(
                as_doubles(reversed(coefs)),
                lambda a: F.struct(a.alias("a"), p.alias("p")),
            ),
            start,
            horner,
        ),
    )
    poly = F.element_at(steps, 1)
    # 2 p(Z) / (L - iz)^2 + 1 / (sqrt(pi) (L - iz)), real part
    sq_re = den_re * den_re - den_im * den_im
    sq_im = 2.0 * den_re * den_im
    sq_norm = norm * norm
    first = (
        2.0
        * (poly.getField("re") * sq_re + poly.getField("im") * sq_im)
        / sq_norm
    )
    return first + den_re / (norm * math.sqrt(math.pi))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, through erfc(t) = exp(-t^2) w(it)."""
    t = F.abs(z) / math.sqrt(2.0)
    scale, coefs = weideman()
    point = (F.lit(scale) - t) / (F.lit(scale) + t)
    poly = F.element_at(
        F.transform(
            F.array(point),
            lambda p: F.aggregate(
                as_doubles(reversed(coefs)), F.lit(0.0), lambda acc, a: acc * p + a
            ),
        ),
        1,
    )
    den = F.lit(scale) + t
    tail = 0.5 * F.exp(-t * t) * (
        2.0 * poly / (den * den) + 1.0 / (den * math.sqrt(math.pi))
    )
    return F.when(z > 0, 1.0 - tail).otherwise(tail)


def bessel_j(order: int, x: np.ndarray) -> np.ndarray:
    """Bessel function of integer order by its integral over one period.

    Arguments are taken in blocks of about a million values under the integral,
    so a large grid needs no more than 8 MB beside its own size."""
    x = np.asarray(x, dtype=float)
    points = int(np.max(np.abs(x), initial=0.0)) + abs(order) + 64
    tau = 2 * np.pi * np.arange(points) / points
    flat, out = x.ravel(), np.empty(x.size)
    step = max(1, (1 << 20) // points)
    for i in range(0, len(flat), step):
        part = order * tau - flat[i : i + step, None] * np.sin(tau)
        out[i : i + step] = np.cos(part, out=part).mean(axis=-1)
    return out.reshape(x.shape)


def bessel_zeros(order: int, count: int) -> np.ndarray:
    """First positive zeros: sign changes on a fine grid, then bisection."""
    upper = (count + abs(order) / 2 + 1) * np.pi + abs(order)
    grid = np.arange(0.05, upper, 0.05)
    values = bessel_j(order, grid)
    at = np.nonzero(values[:-1] * values[1:] < 0)[0][:count]
    low, high = grid[at], grid[at + 1]
    sign = np.sign(values[at])
    for _ in range(60):
        mid = (low + high) / 2
        same = np.sign(bessel_j(order, mid)) == sign
        low, high = np.where(same, mid, low), np.where(same, high, mid)
    return (low + high) / 2


@lru_cache(maxsize=None)
def hankel_kernel(order: int, points: int) -> np.ndarray:
    """K with H = R^2 K f for a profile f on ``points`` nodes and radius R
    (Guizar-Sicairos and Gutierrez-Vega 2004)."""
    zeros = bessel_zeros(order, points + 1)
    alpha, last = zeros[:points], zeros[points]
    weight = np.abs(bessel_j(order + 1, alpha))
    grid = bessel_j(order, np.outer(alpha, alpha) / last)
    symmetric = 2 * grid / (np.outer(weight, weight) * last)
    return (2 * np.pi / last) * weight[:, None] * symmetric / weight[None, :]
