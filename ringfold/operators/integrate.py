"""Image reduction: pixel rows to profiles and cakes by grouped aggregation.

All functions take a *geometry* frame: pixel rows with ``q`` and ``chi`` (see
``calibration.with_geometry``). Bins are equal steps of the q range; a range is
a pair of numbers or of column names (``q_lo``/``q_hi`` by default, which
``calibration.full_q_range`` provides per calibration).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


ID = "measurement_id"
Range = tuple[float | str, float | str]
AUTO: Range = ("q_lo", "q_hi")


def bound(value: float | str | Column) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(float(value))


def mask_pixels(pixels: DataFrame, faulty: list[tuple[int, int]]) -> DataFrame:
    """Drop faulty pixels. The list names detector positions, so it is bounded
    by the detector; as an Arrow table it becomes a local relation of known size,
    which the planner can broadcast."""
    if not faulty:
        return pixels
    rows, cols = zip(*faulty)
    listed = pixels.sparkSession.createDataFrame(
        pa.table(
            {
                "row_idx": pa.array(rows, pa.int32()),
                "col_idx": pa.array(cols, pa.int32()),
            }
        )
    )
    return pixels.join(listed, ["row_idx", "col_idx"], "left_anti")


def in_ranges(
    geo: DataFrame, q_range: Range | None = None, chi_range: Range | None = None
) -> DataFrame:
    for name, limits in (("q", q_range), ("chi", chi_range)):
        if limits is not None:
            geo = geo.filter(
                F.col(name).between(bound(limits[0]), bound(limits[1]))
            )
    return geo


def with_q_bin(geo: DataFrame, npt: int, q_range: Range = AUTO) -> DataFrame:
    """Keep pixels inside the range and number their bin ``pos``. ``q_step`` and
    ``q_first`` describe the grid."""
    lo, hi = bound(q_range[0]), bound(q_range[1])
    share = (F.col("q") - lo) / (hi - lo) * npt
    return in_ranges(geo, q_range).withColumns(
        {
            "pos": F.least(F.floor(share), F.lit(npt - 1)).cast("int"),
            "q_first": lo,
            "q_step": (hi - lo) / npt,
        }
    )


def with_chi_bin(geo: DataFrame, npt_azim: int) -> DataFrame:
    share = (F.col("chi") + 180.0) / 360.0 * npt_azim
    return geo.withColumn(
        "chi_bin", F.least(F.floor(share), F.lit(npt_azim - 1)).cast("int")
    )


def solid_angle() -> Column:
    """Solid angle of a pixel relative to one of the same size at the foot of the
    perpendicular from the sample: the cube of distance over the pixel's own
    distance. Both are measured in the detector's plane, so tilts do not enter."""
    y = (F.col("row_idx") + 0.5) * F.col("pixel1") - F.col("poni1")
    x = (F.col("col_idx") + 0.5) * F.col("pixel2") - F.col("poni2")
    away = F.sqrt(F.col("distance_m") * F.col("distance_m") + y * y + x * x)
    return F.pow(F.col("distance_m") / away, F.lit(3))


def _bin_q() -> Column:
    return F.max("q_first") + (F.col("pos") + 0.5) * F.max("q_step")


def integrate_1d(
    geo: DataFrame,
    npt: int = 256,
    q_range: Range = AUTO,
    chi_range: Range | None = None,
    correct_solid_angle: bool = False,
) -> DataFrame:
    """Profile of each measurement: mean, std and standard error per q bin.

    One shuffle on (measurement, bin), after partial aggregation. With
    ``correct_solid_angle`` the intensity is the sum of values over the sum of
    solid angles; std and standard error stay those of the values.
    """
    binned = with_q_bin(in_ranges(geo, None, chi_range), npt, q_range)
    intensity = F.sum("value") / F.sum(solid_angle()) if correct_solid_angle else F.avg("value")
    return (
        binned.groupBy(ID, "pos")
        .agg(
            F.count(F.lit(1)).alias("n_pixels"),
            _bin_q().alias("q"),
            F.max("q_first").alias("q_first"),
            F.max("q_step").alias("q_step"),
            intensity.alias("intensity"),
            F.stddev_pop("value").alias("std"),
            F.max("distance_m").alias("calculated_distance"),
            F.max(F.col("poni2") / F.col("pixel2")).alias("center_x"),
            F.max(F.col("poni1") / F.col("pixel1")).alias("center_y"),
        )
        .withColumn("sem", F.col("std") / F.sqrt("n_pixels"))
    )


def integrate_2d(
    geo: DataFrame,
    npt: int = 256,
    npt_azim: int = 360,
    q_range: Range = AUTO,
    chi_range: Range | None = None,
    correct_solid_angle: bool = False,
) -> DataFrame:
    """Cake of each measurement: mean per (azimuth bin, q bin), or the sum of
    values over the sum of solid angles."""
    intensity = F.sum("value") / F.sum(solid_angle()) if correct_solid_angle else F.avg("value")
    binned = with_chi_bin(
        with_q_bin(in_ranges(geo, None, chi_range), npt, q_range), npt_azim
    )
    return binned.groupBy(ID, "chi_bin", "pos").agg(
        _bin_q().alias("q"),
        (-180.0 + (F.col("chi_bin") + 0.5) * (360.0 / npt_azim)).alias("chi"),
        intensity.alias("intensity"),
        F.max("q_first").alias("q_first"),
        F.max("q_step").alias("q_step"),
        (F.max("q_first") + (npt - 0.5) * F.max("q_step")).alias("q_max"),
    )


# A variance below this share of the squared mean is round-off.
FLAT = 1e-12


def cake_stats(cake: DataFrame) -> DataFrame:
    """Moments of each cake column over its non-zero bins. Skewness and excess
    kurtosis are null for a flat column."""
    value = F.col("intensity")
    stats = (
        cake.filter(value != 0)
        .groupBy(ID, "pos")
        .agg(
            F.avg(value).alias("cake_col_mean"),
            F.var_pop(value).alias("cake_col_variance"),
            F.stddev_pop(value).alias("cake_col_std"),
            F.skewness(value).alias("skew"),
            F.kurtosis(value).alias("kurtosis"),
        )
    )
    varied = F.col("cake_col_variance") > FLAT * F.pow("cake_col_mean", F.lit(2))
    return stats.select(
        ID,
        "pos",
        "cake_col_mean",
        "cake_col_variance",
        "cake_col_std",
        F.when(varied, F.col("skew")).alias("cake_col_skew"),
        F.when(varied, F.col("kurtosis")).alias("cake_col_kurtosis"),
    )


def value_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values per key with their number ``n``. Detector counts repeat
    a lot, and equal values of a key are combined before they are shuffled."""
    return rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))


def sigma_clip(
    geo: DataFrame,
    npt: int = 256,
    thres: float = 3.0,
    max_iter: int = 5,
    q_range: Range = AUTO,
    chi_range: Range | None = None,
    correct_solid_angle: bool = False,
) -> DataFrame:
    """Profile after dropping pixels farther than ``thres`` std from the mean of
    their bin, repeated ``max_iter`` times. With ``correct_solid_angle`` every
    value is divided by its pixel's solid angle first.

    A pixel survives while its value lies in every interval so far. Equal values
    of a bin are counted before the shuffle; then the distinct values of a bin,
    at most its pixels of one detector, are one ordered array, and each round
    keeps a slice of it. A bin that loses all pixels is left out.
    """
    if correct_solid_angle:
        geo = geo.withColumn("value", F.col("value") / solid_angle())
    rows = with_q_bin(in_ranges(geo, None, chi_range), npt, q_range)
    keys = [ID, "pos"]
    counts = rows.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("q_first").alias("q_first"),
        F.max("q_step").alias("q_step"),
    )
    bins = counts.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("value", "n"))).alias("_values"),
        _bin_q().alias("q"),
        F.max("q_first").alias("q_first"),
        F.max("q_step").alias("q_step"),
    )

    def clipped(lists: pa.Array) -> pa.Array:
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        values = flat.field(0).cast(pa.float64()).to_numpy(zero_copy_only=False)
        counted = flat.field(1).to_numpy(zero_copy_only=False)
        ends = ends - ends[0]
        found = [_clip(values[i:j], counted[i:j], thres, max_iter) for i, j in zip(ends[:-1], ends[1:])]
        columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.float64(), pa.float64()))] if found else [
            pa.array([], k) for k in (pa.int64(), pa.float64(), pa.float64())
        ]
        return pa.StructArray.from_arrays(columns, ["n", "mean", "std"])

    # said to be nondeterministic, so that it is worked out once
    clip = F.arrow_udf(clipped, "struct<n:long,mean:double,std:double>").asNondeterministic()
    return (
        bins.withColumn("_c", clip("_values"))
        .where("_c.n > 0")
        .select(
            *keys,
            "q",
            "q_first",
            "q_step",
            F.col("_c.n").alias("n_pixels"),
            F.col("_c.mean").alias("intensity"),
            F.col("_c.std").alias("std"),
            (F.col("_c.std") / F.sqrt("_c.n")).alias("sem"),
        )
    )


def _clip(values: np.ndarray, counts: np.ndarray, thres: float, rounds: int) -> tuple[int, float, float]:
    """Number, mean and std of what is left of ordered values with counts."""
    n, center, std = 0, float(np.average(values, weights=counts)), 0.0
    for number in range(rounds + 1):
        if number:
            # the slack keeps equal values whose mean is off by round-off
            reach = thres * std + FLAT * abs(center)
            i = np.searchsorted(values, center - reach, "left")
            j = np.searchsorted(values, center + reach, "right")
            values, counts = values[i:j], counts[i:j]
        n = int(counts.sum())
        if n == 0:
            return 0, float("nan"), float("nan")
        # moments about the last mean lose no digits to a large offset
        off = values - center
        shift = float((counts * off).sum()) / n
        spread = float((counts * off * off).sum()) / n - shift * shift
        center, std = center + shift, max(spread, 0.0) ** 0.5
    return n, center, std


# Fixed value: the message for angles out of range.
OUT_OF_RANGE = "The angles must be within -180 and 180 degrees range."


def split_ranges(
    df: DataFrame, start: str = "range_start", end: str = "range_end"
) -> DataFrame:
    """Angular ranges as one or two parts within [-180, 180].

    A range starts at its direction and turns by ``width`` degrees; a turn of
    nothing from a smaller to a larger number is a full circle. What reaches
    the boundary is cut there: part 0 lies after it, part 1 before. ``weight``
    is a part's share of the width (null where that is 0).
    """
    first, last = F.col(start).cast("double"), F.col(end).cast("double")
    allowed = F.when((first < -180) | (last > 180), F.raise_error(F.lit(OUT_OF_RANGE)).cast("double"))
    turn = F.pmod(last - first, F.lit(360.0))
    told = df.withColumns(
        {
            "_from": F.pmod(F.coalesce(allowed, first) + 180, F.lit(360.0)) - 180,
            "_to": F.pmod(last + 180, F.lit(360.0)) - 180,
            "_width": F.when((turn == 0) & (last > first), 360.0).otherwise(turn),
        }
    )
    begin, stop, width = F.col("_from"), F.col("_to"), F.col("_width")

    def part(number: int, lo: Column, hi: Column, size: Column) -> Column:
        return F.struct(
            F.lit(number).alias("part"),
            lo.alias("lo"),
            hi.alias("hi"),
            F.try_divide(size, width).alias("weight"),
        )

    edge = F.lit(180.0)
    cut = F.array(part(0, -edge, stop, stop + edge), part(1, begin, edge, edge - begin))
    whole = F.array(part(0, begin, stop, width))
    reaches = (width == 0) | (begin + width >= 180)
    rows = told.withColumn("_part", F.explode(F.when(reaches, cut).otherwise(whole)))
    return rows.select(*df.columns, "_part.part", "_part.lo", "_part.hi", "_part.weight")


def _parts_of(geo: DataFrame, angles: list[tuple[float, float]]) -> list[dict]:
    """The parts of a short list of ranges given as a parameter."""
    if any(a < -180 or b > 180 for a, b in angles):
        raise ValueError(OUT_OF_RANGE)
    given = [(i, float(a), float(b)) for i, (a, b) in enumerate(angles)]
    ranges = geo.sparkSession.createDataFrame(
        given, "number int, range_start double, range_end double"
    )
    return [r.asDict() for r in split_ranges(ranges).collect()]


def rotating_angles(
    geo: DataFrame,
    angles: list[tuple[float, float]],
    npt: int = 256,
    q_range: Range = AUTO,
    correct_solid_angle: bool = False,
) -> DataFrame:
    """Profile of each measurement in each angular range.

    A pixel is repeated only for the ranges it lies in. Both parts of a split
    range are aggregated side by side in one shuffle and recombined by weight;
    a part without pixels counts as 0.
    """
    chi = F.col("chi")
    hits = [
        F.when(
            chi.between(p["lo"], p["hi"]),
            F.struct(
                F.lit(p["number"]).alias("range_no"),
                F.lit(p["range_start"]).alias("range_start"),
                F.lit(p["range_end"]).alias("range_end"),
                F.lit(p["part"]).alias("part"),
                F.lit(p["weight"]).alias("weight"),
            ),
        )
        for p in _parts_of(geo, angles)
    ]
    rows = (
        with_q_bin(geo, npt, q_range)
        .withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
        .withColumn("_solid", solid_angle() if correct_solid_angle else F.lit(1.0))
        .select(ID, "pos", "value", "_solid", "q_first", "q_step", "_hit.*")
    )
    per_part = []
    for number in (0, 1):
        here = F.when(F.col("part") == number, F.col("value"))
        mean = F.avg(here)
        if correct_solid_angle:
            mean = F.sum(here) / F.sum(F.when(F.col("part") == number, F.col("_solid")))
        weight = F.max(F.when(F.col("part") == number, F.col("weight")))
        per_part += [
            mean.alias(f"mean{number}"),
            F.stddev_pop(here).alias(f"std{number}"),
            F.count(here).alias(f"n{number}"),
            weight.alias(f"w{number}"),
        ]
    stats = rows.groupBy(
        ID, "range_no", "range_start", "range_end", "pos"
    ).agg(
        _bin_q().alias("q"),
        F.max("q_first").alias("q_first"),
        F.max("q_step").alias("q_step"),
        *per_part,
    )

    def part(column: str, number: int) -> Column:
        return F.coalesce(
            F.col(f"w{number}") * F.col(f"{column}{number}"), F.lit(0.0)
        )

    def sem(number: int) -> Column:
        return F.coalesce(
            F.col(f"w{number}")
            * F.try_divide(F.col(f"std{number}"), F.sqrt(f"n{number}")),
            F.lit(0.0),
        )

    def joint(first: Column, second: Column) -> Column:
        return F.sqrt(first * first + second * second)

    return stats.select(
        ID,
        "range_no",
        "range_start",
        "range_end",
        "pos",
        "q",
        "q_first",
        "q_step",
        (part("mean", 0) + part("mean", 1)).alias("intensity"),
        joint(sem(0), sem(1)).alias("sigma"),
        joint(part("std", 0), part("std", 1)).alias("std"),
    )


def rotating_angles_wide(
    long: DataFrame, angles: list[tuple[float, float]], keys: list[str] | None = None
) -> DataFrame:
    """One column set per range, named by its limits as given. The list of
    ranges is known, so no pass is needed to find the pivot values."""
    keys = keys or [ID, "pos"]
    wide = []
    for number, (start, end) in enumerate(angles):
        here = F.col("range_no") == number
        for source, name in (
            ("q", "q_range"),
            ("intensity", "radial_profile_data"),
            ("sigma", "sigma"),
            ("std", "std"),
        ):
            wide.append(
                F.max(F.when(here, F.col(source))).alias(f"{name}_{start}_{end}")
            )
    return long.groupBy(*keys).agg(*wide)


def default_geometry(
    pixels: DataFrame, calibrations: DataFrame, n_rows: int, n_cols: int
) -> DataFrame:
    """Pixels with geometry and the full detector range of their calibration."""
    from .calibration import attach_calibration, full_q_range, with_geometry

    dimension = full_q_range(calibrations, n_rows, n_cols)
    return with_geometry(attach_calibration(pixels, dimension))
