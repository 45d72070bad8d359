"""Small symmetric systems solved row by row in plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .columns import total


def solved(
    df: DataFrame,
    size: int,
    product: Callable[[int, int], Column],
    right: Callable[[int], Column],
    least: float = 1e-9,
    name: str = "a",
) -> DataFrame:
    """Adds a0, a1, ...: the solution of the normal equations of each row.

    ``product(i, j)`` (i >= j) and ``right(i)`` give their entries. A row whose
    triangular factorization meets a pivot below ``least`` of its diagonal entry
    has no unique solution and gets nulls.
    """
    kept = df.columns
    df = df.withColumns(
        {f"_g{i}_{j}": product(i, j) for i in range(size) for j in range(i + 1)}
        | {f"_r{i}": right(i) for i in range(size)}
    )
    for j in range(size):
        pivot = F.col(f"_g{j}_{j}") - total(
            [F.col(f"_l{j}_{k}") * F.col(f"_l{j}_{k}") * F.col(f"_d{k}") for k in range(j)]
        )
        df = df.withColumn(f"_d{j}", pivot).withColumn(
            f"_d{j}", F.when(F.col(f"_d{j}") > least * F.col(f"_g{j}_{j}"), F.col(f"_d{j}"))
        )
        below = {
            f"_l{i}_{j}": (
                F.col(f"_g{i}_{j}")
                - total([F.col(f"_l{i}_{k}") * F.col(f"_l{j}_{k}") * F.col(f"_d{k}") for k in range(j)])
            )
            / F.col(f"_d{j}")
            for i in range(j + 1, size)
        }
        below[f"_z{j}"] = F.col(f"_r{j}") - total([F.col(f"_l{j}_{k}") * F.col(f"_z{k}") for k in range(j)])
        df = df.withColumns(below)
    for j in reversed(range(size)):
        df = df.withColumn(
            f"_a{j}",
            F.col(f"_z{j}") / F.col(f"_d{j}")
            - total([F.col(f"_l{i}_{j}") * F.col(f"_a{i}") for i in range(j + 1, size)]),
        )
    return df.select(*kept, *[F.col(f"_a{j}").alias(f"{name}{j}") for j in range(size)])
