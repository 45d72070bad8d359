"""Terms of a fitted curve, as Column expressions.

A term is linear in some parameters and not in the others (its *shape*). The
linear ones multiply the columns of ``basis``; a fit searches over shapes only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, functions as F

from ..functions.columns import total
from ..functions.special import faddeeva_real, gamma, normal_cdf

INF = float("inf")


@dataclass(frozen=True)
class Parameter:
    """A parameter with its first guess, bounds, and whether it is reported."""

    value: float
    min_value: float = -INF
    max_value: float = INF
    returned: bool = True


def _column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


@dataclass(frozen=True)
class Term:
    """Base of the terms; the dataclass fields are its parameters in order."""

    linear = ()
    squared = False

    @property
    def names(self) -> list[str]:
        return [f.name for f in fields(self)]

    @property
    def parameters(self) -> list[Parameter]:
        return [getattr(self, n) for n in self.names]

    @property
    def shape(self) -> list[str]:
        return [n for n in self.names if n not in self.linear]

    def get_param_count(self) -> int:
        return len(self.names)

    def min_bounds(self) -> list[float]:
        return [p.min_value for p in self.parameters]

    def max_bounds(self) -> list[float]:
        return [p.max_value for p in self.parameters]

    def initial_guess(self) -> list[float]:
        return [p.value for p in self.parameters]

    def returned_values(self) -> list[bool]:
        return [p.returned for p in self.parameters]

    def basis(self, x: Column, shape: dict[str, Column]) -> list[Column]:
        """One column per linear parameter, in the order of ``linear``."""
        raise NotImplementedError

    def calculate(self, x: Column, *params) -> Column:
        named = dict(zip(self.names, [_column(p) for p in params]))
        factors = [named[n] * named[n] if self.squared else named[n] for n in self.linear]
        columns = self.basis(x, {n: named[n] for n in self.shape})
        return total([f * b for f, b in zip(factors, columns)])


@dataclass(frozen=True)
class ConstantBackground(Term):
    constant: Parameter
    linear = ("constant",)

    def basis(self, x, shape):
        return [F.lit(1.0)]


@dataclass(frozen=True)
class InversePowerBackground(Term):
    power: Parameter
    coef: Parameter
    constant: Parameter
    linear = ("coef", "constant")

    def basis(self, x, shape):
        return [F.pow(x, -shape["power"]), F.lit(1.0)]


@dataclass(frozen=True)
class GaussianPeak(Term):
    amp: Parameter
    cen: Parameter
    sigma: Parameter
    linear = ("amp",)

    def basis(self, x, shape):
        t = (x - shape["cen"]) / shape["sigma"]
        return [F.exp(t * t * -0.5)]


@dataclass(frozen=True)
class LorentzianPeak(Term):
    amp: Parameter
    cen: Parameter
    gamma: Parameter
    linear = ("amp",)

    def basis(self, x, shape):
        far = x - shape["cen"]
        wide = shape["gamma"] * shape["gamma"]
        return [wide / (far * far + wide)]


def _voigt(x: Column, shape: dict[str, Column]) -> Column:
    unit = shape["sigma"] * math.sqrt(2.0)
    real = faddeeva_real((x - shape["cen"]) / unit, shape["gamma"] / unit)
    return real / (shape["sigma"] * math.sqrt(2 * math.pi))


@dataclass(frozen=True)
class VoigtPeak(Term):
    amp: Parameter
    cen: Parameter
    sigma: Parameter
    gamma: Parameter
    linear = ("amp",)

    def basis(self, x, shape):
        return [_voigt(x, shape)]


@dataclass(frozen=True)
class SkewedVoigtPeak(Term):
    """The amplitude enters twice, so the curve is linear in its square."""

    amp: Parameter
    cen: Parameter
    sigma: Parameter
    gamma: Parameter
    alpha: Parameter
    linear = ("amp",)
    squared = True

    def basis(self, x, shape):
        skew = normal_cdf(shape["alpha"] * (x - shape["cen"]) / shape["sigma"])
        return [2.0 * _voigt(x, shape) * skew]


@dataclass(frozen=True)
class GammaDistributionPeak(Term):
    amp: Parameter
    position: Parameter
    k: Parameter
    theta: Parameter
    linear = ("amp",)

    def basis(self, x, shape):
        k, theta = shape["k"], shape["theta"]
        u = F.greatest(x - shape["position"], F.lit(0.0))
        density = F.pow(u, k - 1) * F.exp(-u / theta) / (gamma(k) * F.pow(theta, k))
        bad = (k <= 0) | (theta <= 0)
        message = "gamma peak: k and theta must be positive"
        return [
            F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(density)
        ]


@dataclass(frozen=True)
class TermSum:
    """A sum of terms with its parameters in one list."""

    functions: tuple[Term, ...]

    def get_function_count(self) -> int:
        return len(self.functions)

    def get_function_param_counts(self) -> list[int]:
        return [f.get_param_count() for f in self.functions]

    def bounds(self) -> tuple[list[float], list[float]]:
        return (
            [b for f in self.functions for b in f.min_bounds()],
            [b for f in self.functions for b in f.max_bounds()],
        )

    def initial_guess(self) -> list[float]:
        return [v for f in self.functions for v in f.initial_guess()]

    def returned_values(self) -> list[int]:
        flags = [r for f in self.functions for r in f.returned_values()]
        return [i for i, r in enumerate(flags) if r]

    def produce_function(self):
        """A function (x, *params) of Columns."""

        def combined(x: Column, *params) -> Column:
            parts, at = [], 0
            for f in self.functions:
                parts.append(f.calculate(x, *params[at : at + f.get_param_count()]))
                at += f.get_param_count()
            return total(parts)

        return combined
