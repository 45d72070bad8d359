"""Transforms of 1-D profiles.

Functions on Columns work on array cells and never shuffle; functions on frames
work on point rows (measurement_id, pos, intensity, n_points).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import total
from ..functions.skew import attach
from .integrate import ID

TWO_PI = 2 * math.pi


def _with_constants(curve: Column, constants: Column) -> Column:
    """Entries (v, i, k): value, position and the row's constants.

    A lambda must not mention the curve itself: when the optimizer inlines the
    expression behind it, it would be evaluated again for every value.
    """
    n = F.size(curve)
    placed = F.zip_with(
        curve,
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda v, i: F.struct(v.alias("v"), i.alias("i")),
    )
    return F.slice(
        F.zip_with(
            placed,
            F.array_repeat(constants, n),
            lambda p, k: F.struct(
                p.getField("v").alias("v"), p.getField("i").alias("i"), k.alias("k")
            ),
        ),
        F.lit(1),
        n,
    )


def _ends(curve: Column) -> tuple[Column, Column]:
    """First value, and the step of the line to the last."""
    first, last = F.get(curve, F.lit(0)), F.get(curve, F.size(curve) - 1)
    step = F.coalesce(F.try_divide(last - first, F.size(curve) - 1), F.lit(0.0))
    return first, step


def slope_removed(curve: Column) -> Column:
    """Subtract the line through the first and last value."""
    first, step = _ends(curve)
    constants = F.struct(first.alias("first"), step.alias("step"))
    return F.transform(
        _with_constants(curve, constants),
        lambda e: e.getField("v")
        - (
            e.getField("k").getField("first")
            + e.getField("k").getField("step") * e.getField("i")
        ),
    )


def slope_rotated(curve: Column) -> Column:
    """Shift the start to 0 and rotate the end onto the axis: struct (y, x)."""
    first, step = _ends(curve)
    constants = F.struct(
        first.alias("first"),
        F.cos(F.atan(step)).alias("cos"),
        F.sin(F.atan(step)).alias("sin"),
    )
    entries = _with_constants(curve, constants)

    def turned(along: str, across: str, sign: float):
        def value(e: Column) -> Column:
            k = e.getField("k")
            up = e.getField("v") - k.getField("first")
            right = e.getField("i")
            if sign < 0:
                return up * k.getField(along) - right * k.getField(across)
            return right * k.getField(along) + up * k.getField(across)

        return F.transform(entries, value)

    return F.struct(
        turned("cos", "sin", -1.0).alias("y"), turned("cos", "sin", 1.0).alias("x")
    )


def simpson_weight(pos: Column, n: Column) -> Column:
    """Weight of a point in Simpson's rule on n unit-spaced points. With an odd
    number of intervals the last one is corrected by a parabola."""
    m = n - (n + 1) % 2
    composite = (
        F.when((pos == 0) | (pos == m - 1), 1.0 / 3)
        .when(pos >= m, 0.0)
        .when(pos % 2 == 1, 4.0 / 3)
        .otherwise(2.0 / 3)
    )
    back = n - 1 - pos
    last = (
        F.when(back == 0, 5.0 / 12)
        .when(back == 1, 8.0 / 12)
        .when(back == 2, -1.0 / 12)
        .otherwise(0.0)
    )
    return (
        F.when(n == 2, 0.5)
        .when(n % 2 == 1, composite)
        .otherwise(composite + last)
    )


def with_length(points: DataFrame) -> DataFrame:
    """Add ``n_points`` where the rows do not carry it yet."""
    if "n_points" in points.columns:
        return points
    sizes = points.groupBy(ID).agg(F.count(F.lit(1)).alias("n_points"))
    return attach(points, sizes, [ID], ["pos"])


def _waves(order: int, period: Column) -> list[tuple[Column, Column]]:
    phase = [F.col("pos") * (TWO_PI * k) / period for k in range(1, order + 1)]
    return [(F.cos(p), F.sin(p)) for p in phase]


def fourier_coefficients(
    points: DataFrame, order: int, mode: str = "fft", value: str = "intensity"
) -> DataFrame:
    """One row per measurement: ``base`` and arrays ``first`` and ``second``.

    Mode ``custom`` integrates the series by Simpson's rule (a0, a_n, b_n);
    otherwise discrete transform (F_0, real, imaginary). All sums are taken
    side by side, so points are combined before the one shuffle.
    """
    rows = with_length(points)
    n = F.col("n_points")
    if mode == "custom":
        period = n - 1
        y = F.col(value) * simpson_weight(F.col("pos"), n) * 2.0 / period
        sign = 1.0
    else:
        period = n
        y = F.col(value)
        sign = -1.0
    waves = _waves(order, period)
    return (
        rows.withColumn("_y", y)
        .groupBy(ID)
        .agg(
            F.max("n_points").alias("n_points"),
            F.sum("_y").alias("base"),
            F.array(*[F.sum(F.col("_y") * c) for c, _ in waves]).alias("first"),
            F.array(*[sign * F.sum(F.col("_y") * s) for _, s in waves]).alias(
                "second"
            ),
        )
    )


def coefficients_long(coefficients: DataFrame, first: str, second: str) -> DataFrame:
    return coefficients.select(
        ID, F.posexplode(F.arrays_zip("first", "second")).alias("_at", "_c")
    ).select(
        ID,
        (F.col("_at") + 1).alias("n"),
        F.col("_c.first").alias(first),
        F.col("_c.second").alias(second),
    )


def _reconstruction(order: int, mode: str) -> Column:
    """Value at ``pos`` from the coefficients carried by the row."""
    period = F.col("n_points") - (1 if mode == "custom" else 0)
    sign = 1.0 if mode == "custom" else -1.0
    terms = [
        F.get("first", F.lit(k)) * c + sign * F.get("second", F.lit(k)) * s
        for k, (c, s) in enumerate(_waves(order, period))
    ]
    if mode == "custom":
        return F.col("base") / 2 + total(terms)
    return (F.col("base") + 2 * total(terms)) / F.col("n_points")


def fourier_inverse(
    points: DataFrame, order: int, mode: str = "fft", value: str = "intensity"
) -> DataFrame:
    """Points with ``inverse``: the curve rebuilt from its low orders.

    The discrete inverse of a real curve is real: the coefficients kept at both
    ends are conjugates. When they overlap nothing was removed.
    """
    rows = with_length(points)
    coefficients = fourier_coefficients(rows, order, mode, value).drop("n_points")
    joined = attach(rows, coefficients, [ID], ["pos"])
    rebuilt = _reconstruction(order, mode)
    if mode != "custom":
        rebuilt = F.when(
            F.col("n_points") <= 2 * order + 1, F.col(value)
        ).otherwise(rebuilt)
    return joined.withColumn("inverse", rebuilt).drop("base", "first", "second")


def fourier_cells(
    df: DataFrame, columns: list[str], order: int = 15, mode: str = ""
) -> DataFrame:
    """Array-cell form: adds ``fourier_coefficients_{c}`` (both halves in one
    array) and ``fourier_inverse_{c}`` for each column, without a shuffle."""
    custom = mode == "custom"
    for column in columns:
        curve = F.col(column)
        n = F.size(curve)
        period = n - 1 if custom else n
        scaled = (
            F.transform(curve, lambda y, i: y * simpson_weight(i, n) * 2.0 / period)
            if custom
            else curve
        )

        def summed(array: Column) -> Column:
            return F.aggregate(array, F.lit(0.0), lambda a, b: a + b)

        def projected(wave, sign: float) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.lit(order)),
                lambda k: sign
                * summed(
                    F.transform(
                        F.col("_scaled"),
                        lambda y, i: y * wave(i * k * F.lit(TWO_PI) / period),
                    )
                ),
            )

        # the projected steps keep every array computed once
        df = df.withColumn("_scaled", scaled)
        df = df.withColumns(
            {
                "_first": projected(F.cos, 1.0),
                "_second": projected(F.sin, 1.0 if custom else -1.0),
                "_base": summed(F.col("_scaled")),
            }
        )
        sign = 1.0 if custom else -1.0

        def rebuilt(i: Column) -> Column:
            waves = F.zip_with(
                F.col("_first"),
                F.col("_second"),
                lambda a, b: F.struct(a.alias("a"), b.alias("b")),
            )
            return summed(
                F.transform(
                    waves,
                    lambda c, k: c.getField("a")
                    * F.cos(i * (k + 1) * F.lit(TWO_PI) / period)
                    + sign
                    * c.getField("b")
                    * F.sin(i * (k + 1) * F.lit(TWO_PI) / period),
                )
            )

        inverse = F.transform(
            curve,
            lambda y, i: F.col("_base") / 2 + rebuilt(i)
            if custom
            else F.when(n <= 2 * order + 1, y).otherwise(
                (F.col("_base") + 2 * rebuilt(i)) / n
            ),
        )
        df = df.withColumns(
            {
                f"fourier_coefficients_{column}": F.concat("_first", "_second"),
                f"fourier_inverse_{column}": inverse,
            }
        ).drop("_scaled", "_first", "_second", "_base")
    return df
