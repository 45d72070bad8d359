"""Pixels and cake bins that deviate from the mean of their ring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .integrate import AUTO, FLAT, ID, Range, bound, value_counts

Limits = list[float]


def _sides(above: Limits, below: Limits) -> list[tuple[str, float]]:
    return [("above", float(x)) for x in above] + [
        ("below", float(x)) for x in below
    ]


def _long(stats: DataFrame, keys: list[str], sides: list[tuple[str, float]]) -> DataFrame:
    """One row per (side, limit) from the side-by-side aggregates d0, d1, ..."""
    entries = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                F.lit(limit).alias("limit"),
                F.col(f"d{i}").alias("deviation"),
            )
            for i, (side, limit) in enumerate(sides)
        ]
    )
    return stats.select(*keys, F.explode(entries).alias("_e")).select(*keys, "_e.*")


def with_digit(geo: DataFrame, npt: int, q_range: Range = AUTO) -> DataFrame:
    """Number of bin centers at or below q: 0 to npt, all pixels included."""
    lo, hi = bound(q_range[0]), bound(q_range[1])
    steps = F.floor((F.col("q") - lo) / (hi - lo) * npt + 0.5)
    return geo.withColumn(
        "digit", F.greatest(F.lit(0), F.least(F.lit(npt), steps)).cast("int")
    )


def _beyond(side: str, limit: float, value: Column, mean: Column) -> Column:
    """Strictly beyond the limit by more than round-off: the last bit of a mean
    depends on the order of summation and must not decide."""
    slack = FLAT * F.abs(mean)
    if side == "above":
        return value > mean * limit + slack
    return value < mean * limit - slack


def _flag(side: str, limit: float, value: Column, mean: Column) -> Column:
    hit = _beyond(side, limit, value, mean)
    return hit if side == "above" else hit & (value != 0)


def with_ring_mean(geo: DataFrame, npt: int, q_range: Range = AUTO) -> DataFrame:
    rows = with_digit(geo, npt, q_range).select(
        ID, "row_idx", "col_idx", "digit", "value"
    )
    means = rows.groupBy(ID, "digit").agg(F.avg("value").alias("ring_mean"))
    return rows.join(means, [ID, "digit"])


def deviation(
    geo: DataFrame,
    above: Limits = (1.2,),
    below: Limits = (0.8,),
    npt: int = 256,
    q_range: Range = AUTO,
) -> DataFrame:
    """Mean of the flagged pixels per ring and limit, null where none is. Only
    values matter here, so rings are compared by their value counts."""
    sides = _sides(above, below)
    keys = [ID, "digit"]
    counts = value_counts(with_digit(geo, npt, q_range), keys)
    value, mean, n = F.col("value"), F.col("ring_mean"), F.col("n")
    means = counts.groupBy(*keys).agg(
        (F.sum(value * n) / F.sum(n)).alias("ring_mean")
    )

    def flagged_mean(side: str, limit: float) -> Column:
        hit = _flag(side, limit, value, mean)
        return F.try_divide(F.sum(F.when(hit, value * n)), F.sum(F.when(hit, n)))

    stats = (
        counts.join(means, keys)
        .groupBy(*keys)
        .agg(*[flagged_mean(s, x).alias(f"d{i}") for i, (s, x) in enumerate(sides)])
    )
    return _long(stats, keys, sides)


def deviation_images(
    geo: DataFrame,
    above: Limits = (1.2,),
    below: Limits = (0.8,),
    npt: int = 256,
    q_range: Range = AUTO,
) -> DataFrame:
    """Pixel rows with one image column per limit: the value if flagged, else 0."""
    rows = with_ring_mean(geo, npt, q_range)
    value, mean = F.col("value"), F.col("ring_mean")
    return rows.select(
        ID,
        "row_idx",
        "col_idx",
        *[
            F.when(_flag(side, limit, value, mean), value)
            .otherwise(0.0)
            .alias(f"image_{side}_{limit}")
            for side, limit in _sides(above, below)
        ],
    )


def with_column_mean(cake: DataFrame) -> DataFrame:
    """Add the mean of each cake column over its non-zero bins."""
    lit = F.when(F.col("intensity") != 0, F.col("intensity"))
    stats = cake.groupBy(ID, "pos").agg(
        F.avg(lit).alias("column_mean"), F.count(lit).alias("n_lit")
    )
    return cake.join(stats, [ID, "pos"])


def cake_deviation(
    cake: DataFrame,
    npt_azim: int = 360,
    above: Limits = (1.2,),
    below: Limits = (0.8,),
) -> DataFrame:
    """Mean of the flagged cake bins per column and limit; a mean of 0 is null.

    Bins no pixel falls in are 0 in a cake. They are not stored as rows, so
    their number enters the mean of a limit they satisfy.
    """
    sides = _sides(above, below)
    rows = with_column_mean(cake).filter(F.col("column_mean").isNotNull())
    value, mean = F.col("intensity"), F.col("column_mean")

    def flagged_mean(side: str, limit: float) -> Column:
        level = mean * limit
        hit = _beyond(side, limit, value, mean) & (value != 0)
        zero_hit = (level < 0) if side == "above" else (level > 0)
        zeros = F.when(F.max(zero_hit), F.lit(npt_azim) - F.max("n_lit")).otherwise(0)
        mean_hit = F.try_divide(
            F.sum(F.when(hit, value)), F.count(F.when(hit, value)) + zeros
        )
        return F.when(mean_hit != 0, mean_hit)

    stats = rows.groupBy(ID, "pos").agg(
        *[flagged_mean(s, x).alias(f"d{i}") for i, (s, x) in enumerate(sides)]
    )
    return _long(stats, [ID, "pos"], sides)


def cake_flags(
    cake: DataFrame, above: Limits = (1.2,), below: Limits = (0.8,)
) -> DataFrame:
    """Cake rows with one column per limit: the bin if flagged, else 0."""
    value, mean = F.col("intensity"), F.col("column_mean")
    return with_column_mean(cake).select(
        ID,
        "chi_bin",
        "pos",
        *[
            F.when(_beyond(side, limit, value, mean), value)
            .otherwise(0.0)
            .alias(f"cake_{side}_{limit}")
            for side, limit in _sides(above, below)
        ],
    )


def project_back(binned: DataFrame, flags: DataFrame) -> DataFrame:
    """Flagged cake bins back on the pixels that fall in them."""
    columns = [c for c in flags.columns if c.startswith("cake_")]
    joined = binned.select(ID, "row_idx", "col_idx", "chi_bin", "pos").join(
        flags, [ID, "chi_bin", "pos"]
    )
    return joined.select(
        ID,
        "row_idx",
        "col_idx",
        *[F.col(f"`{c}`").alias(c.replace("cake_", "image_", 1)) for c in columns],
    )


def deviation_wide(long: DataFrame, key: str, above: Limits, below: Limits) -> DataFrame:
    """The long result with one column per limit, named by it."""
    return long.groupBy(ID, key).agg(
        *[
            F.max(
                F.when(
                    (F.col("side") == side) & (F.col("limit") == limit),
                    F.col("deviation"),
                )
            ).alias(f"deviation_{side}_{limit}")
            for side, limit in _sides(above, below)
        ]
    )
